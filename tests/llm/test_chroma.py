import numpy as np
import pytest

from matchloom.llm import chroma as ch
from tests.llm.helpers import awkward, empty

ST = ch.ChromaSettings(max_error=0.15, min_overlap=64)  # long enough that chance does not align strangers


def melody(seed, seconds=1.5):
    """Notes of a scale as 8-bit samples."""
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(int(seconds * 10)):
        hz = 440 * 2 ** (rng.integers(0, 30) / 12)
        parts.append(np.sin(2 * np.pi * hz * np.arange(800) / 8000) + 0.5 * np.sin(4 * np.pi * hz * np.arange(800) / 8000))
    return np.clip(128 + 60 * np.concatenate(parts) + rng.normal(0, 2, 800 * len(parts)), 0, 255).astype(np.uint8).tobytes()


def plain_fingerprint(audio):
    """Frame by frame and filter by filter, summing areas cell by cell."""
    samples = np.frombuffer(audio, np.uint8).astype(float) - 128
    classes = ch.pitch_classes(ST)
    frames = [samples[i : i + ST.frame] for i in range(0, len(samples) - ST.frame + 1, ST.hop)]
    bare = [np.abs(np.fft.rfft(f * np.hamming(ST.frame))) ** 2 @ classes for f in frames]
    picture = []
    for t in range(len(bare)):
        row = sum(w * bare[t + k - 2] for k, w in enumerate(ch.SMOOTHING) if 0 <= t + k - 2 < len(bare))
        size = np.sqrt((row**2).sum())
        picture.append(np.rint((row / size if size > 1e-6 else np.full(12, 12**-0.5)) * 4096).astype(int))
    out = []
    for t in range(len(picture) - ch.WIDTH + 1):
        bits = 0
        for kind, first, height, width in ch.FILTERS:
            def area(a, b, p, q):
                return sum(int(picture[t + x][y]) for x in range(a, b) for y in range(p, q))

            top, mid, half, third = first + height, first + height // 2, width // 2, width // 3
            if kind == "low_high":
                a, b = area(0, width, first, mid), area(0, width, mid, top)
            elif kind == "early_late":
                a, b = area(0, half, first, top), area(half, width, first, top)
            elif kind == "corners":
                a = area(0, half, first, mid) + area(half, width, mid, top)
                b = area(0, half, mid, top) + area(half, width, first, mid)
            else:
                a = 2 * area(third, 2 * third, first, top)
                b = area(0, third, first, top) + area(2 * third, 3 * third, first, top)
            value, border = np.log((4096 + a) / (4096 + b)), ch.BORDERS[kind]
            bits = bits << 2 | (0 if value <= -border else 1 if value <= 0 else 3 if value <= border else 2)
        out.append(bits)
    return np.array(out, np.uint32)


def test_fingerprint_is_that_of_plain_sums(monkeypatch):
    sounds = [melody(1, 0.4), b"", b"\x80" * 255, b"\x80" * 1500, melody(2, 0.3), bytes(range(256)) * 6]
    want = [plain_fingerprint(s) for s in sounds]
    for piece in (8192, 5):
        monkeypatch.setattr(ch, "_PIECE", piece)
        for a, b in zip(ch.fingerprints_of(sounds), want):
            assert a.tolist() == b.tolist()


def brute_error(a, b, offset):
    lo, hi = max(offset, 0), min(len(a), len(b) + offset)
    if hi - lo < ST.min_overlap:
        return 1.0
    return np.unpackbits((a[lo:hi] ^ b[lo - offset : hi - offset]).view(np.uint8)).mean()


def test_recordings_align(spark):
    base = [melody(s) for s in range(12)]
    sounds = {100 + i: b for i, b in enumerate(base)}
    sounds |= {200 + i: b[i * 64 * 3 :] for i, b in enumerate(base)}  # begins i * 3 frames later
    rng = np.random.default_rng(5)
    for i, b in enumerate(base):
        noisy = np.frombuffer(b, np.uint8).astype(int) + rng.integers(-6, 7, len(b))
        sounds[300 + i] = np.clip(noisy, 0, 255).astype(np.uint8).tobytes()
    sounds[500] = sounds[100]
    rows = [(d, d % 50 == 0, bytearray(s)) for d, s in sounds.items()]
    df = spark.createDataFrame(rows, "doc_id long, is_query boolean, audio binary")
    prints = ch.fingerprints(df, "audio", ("doc_id", "is_query"))
    got = {r["doc_id"]: r for r in ch.best_matches(prints, ST).collect()}
    assert got[500]["class_id"] == 100 and got[300]["match_id"] == 100 and got[300]["offset"] == 0

    # all pairs: every query with every recording at every offset
    members, matches = ch.align(prints, ST)
    node = {r["node"]: r["doc_id"] for r in members.collect()}
    found = {(node[r["query"]], node[r["node"]]): r["offset"] for r in matches.collect()}
    every = df.withColumn("is_query", df.doc_id > 0)
    all_members, matches = ch.align(ch.fingerprints(every, "audio", ("doc_id", "is_query")), ST)
    names = {r["node"]: r["doc_id"] for r in all_members.collect()}
    pairs = {(names[r["query"]], names[r["node"]]): r["offset"] for r in matches.collect()}
    codes = dict(zip(sounds, ch.fingerprints_of(list(sounds.values()))))
    one = {500: 100}  # equal fingerprints are one recording
    told = {frozenset((one.get(a, a), one.get(b, b))) for a, b in pairs}
    true = set()
    for a in codes:
        for b in codes:
            if a < b and 500 not in (a, b):
                offsets = range(-len(codes[b]), len(codes[a]))
                if min(brute_error(codes[a], codes[b], o) for o in offsets) <= ST.max_error:
                    true.add(frozenset((a, b)))
    assert len(true) >= 36 and len(true & told) >= 0.9 * len(true) and told <= true
    for i in range(1, 12):
        assert pairs[100 + i, 200 + i] == 3 * i
    assert {frozenset((one.get(a, a), one.get(b, b))) for a, b in found} <= told


def test_stretches_vote_by_their_ends():
    prints = np.array([5, 5, 5, 5, 7, 7, 9, 9, 9], np.uint32)
    assert ch.landmarks(prints, np.array([0])).tolist() == [0, 3, 4, 5, 6, 8]
    assert ch.landmarks(prints, np.array([0, 2])).tolist() == [0, 1, 2, 3, 4, 5, 6, 8]
    assert ch.landmarks(np.array([5], np.uint32), np.array([0])).tolist() == [0]


def table_of(spark, prints, queries):
    rows = [(i, i in queries, p.view(np.int32).tolist()) for i, p in prints.items()]
    return spark.createDataFrame(rows, "doc_id long, is_query boolean, fingerprint array<int>")


def test_a_later_repeat_aligns(spark):
    rng = np.random.default_rng(3)
    a, c, d = (rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (200, 120, 50))
    prints = {1: np.concatenate([a, c]), 2: np.concatenate([d, a, a, c]), 3: np.full(4_000, 9, np.uint32), 4: np.full(90, 9, np.uint32)}
    members, matches = ch.align(table_of(spark, prints, {1, 3}))
    ids = {r["node"]: r["doc_id"] for r in members.collect()}
    found = {(ids[r["query"]], ids[r["node"]]): (r["offset"], r["overlap"], r["error"], r["votes"]) for r in matches.collect()}
    assert found == {(1, 2): (-250, 320, 0.0, 320), (3, 4): (0, 90, 0.0, 1)}


def brute_pairs(prints, queries, settings):
    """{(query, recording): least error} over all offsets; equal fingerprints are one recording, named by the least id."""
    one = {}
    for i in sorted(prints):
        one.setdefault(prints[i].tobytes(), i)
    asked = {one[prints[i].tobytes()] for i in queries if len(prints[i]) >= settings.min_overlap}
    out = {}
    for i in asked:
        a = prints[i]
        for j in one.values():
            b = prints[j]
            if i == j or len(b) < settings.min_overlap:
                continue
            bits = np.bitwise_count(a[:, None] ^ b[None, :]).astype(np.int64)
            for o in range(settings.min_overlap - len(b), len(a) - settings.min_overlap + 1):
                cells = np.diagonal(bits, -o)
                if cells.mean() <= 32 * settings.max_error:
                    out[i, j] = min(out.get((i, j), 1.0), cells.mean() / 32)
    return out


def test_recall_at_the_settings_of_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300).collect()
    texts = {r["doc_id"]: (r["text"] or "")[:3_000] for r in [*docs, *more]}
    prints = dict(zip(texts, ch.fingerprints_of([t.encode() for t in texts.values()])))
    queries = {i for i in prints if i % 5 == 0}
    want = brute_pairs(prints, queries, ch.ChromaSettings())
    members, matches = ch.align(table_of(spark, prints, queries))
    least = {}
    for r in members.where("node IS NOT NULL").collect():
        least[r["node"]] = min(r["doc_id"], least.get(r["node"], r["doc_id"]))
    found = {(least[r["query"]], least[r["node"]]): r["error"] for r in matches.collect()}
    assert set(found) <= set(want) and len(want) >= 3
    assert len(set(found) & set(want)) >= 0.9 * len(want)
    assert all(abs(found[p] - want[p]) < 1e-9 for p in found)


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_rows(spark, make):
    docs = make(spark).selectExpr("*", "doc_id % 50 = 0 AS is_query", "CAST(text AS binary) AS audio")
    rows = ch.best_matches(ch.fingerprints(docs, "audio", ("doc_id", "is_query"))).collect()
    assert len(rows) == (11 if make is awkward else 0)
    assert all(r["frames"] == 0 for r in rows if r["doc_id"] != 7)
