import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np

from matchloom.llm import ppm
from tests.llm.helpers import awkward, empty

TRAIN = ["the cat sat on the mat", "A cat and a BAT", "the ño", "", "zzz abc abd", None, "the  the\tend"]


def brute_score(train, text, order):
    seen = defaultdict(Counter)
    for t in train:
        s = [ppm.START] * order + list(t) + [ppm.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    s, total = [ppm.START] * order + list(text) + [ppm.END], 0.0
    for i in range(order, len(s)):
        out, p = set(), 1.0
        k = max((k for k in range(order + 1) if tuple(s[i - k : i]) in seen), default=0)
        while k >= 0:
            known = {a: n for a, n in seen[tuple(s[i - k : i])].items() if a not in out}
            n, kinds = sum(known.values()), len(known)
            if s[i] in known:
                p *= known[s[i]] / (n + kinds)
                break
            p *= kinds / (n + kinds) if kinds else 1
            out |= set(known)
            k -= 1
        else:
            p /= ppm.SYMBOLS - len(out)
        total += math.log10(p)
    return total


def test_scores_of_brute_force(spark):
    training = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    asked = ["the cat", "", None, "xqx the bat sat", "ñoñ 漢", "THE CAT", "the end the end the end"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    # so few words are held that some are joined
    got = {r["doc_id"]: r for r in ppm.scored(docs, training, settings=ppm.PpmSettings(max_words=2)).collect()}
    plain = [(t or "").encode().lower() for t in TRAIN]
    words = Counter(w for t in plain for w in t.split())
    counts, ends = sum(words.values()) + len(plain), len(plain)
    for i, text in enumerate(asked):
        body = (text or "").encode().lower()
        assert abs(got[i]["score"] - brute_score(plain, body, ppm.PpmSettings().order)) < 1e-4
        c = [words[w] for w in body.split()] + [ends]
        assert got[i]["n_tokens"] == len(c) and got[i]["n_known"] == sum(x > 0 for x in c)
        assert got[i]["train_tokens"] == counts
        base = sum(math.log10((x + 1) / (counts + len(words) + 2)) for x in c)
        assert abs(got[i]["base_score"] - base) < 1e-9


def test_bounded_trie_is_a_distribution(spark):
    texts = [(f"some text {i * i} of {i} with {i % 7} parts",) for i in range(300)]
    training = spark.createDataFrame(texts, "text string")
    full = ppm.fit(training)
    small = ppm.fit(training, ppm.PpmSettings(max_contexts=100))
    assert len(small.logs) <= 101 < len(full.logs)
    for model in (full, small):
        share = np.power(10.0, model.logs.astype(float))
        known = share.shape[1] - 1
        assert np.allclose(share[:, :known].sum(axis=1) + share[:, known] * (ppm.SYMBOLS - known), 1, atol=1e-4)
    text = [b"some text 9 of 3 with 3 parts"]
    assert ppm.score_texts(full, text) > ppm.score_texts(small, text) > -len(text[0]) * math.log10(257)


def test_contexts_outside_the_trie_count(spark):
    train = [f"some text {i * i} of {i} with {i % 7} parts" for i in range(60)] + ["ñandú 漢字", "", "zq\x01"] + ["ab" * 9]
    asked = ["some text 81 of 9 with 2 parts", "", None, "ñandú 漢", "of 3 wyth x parts ~~ parts", "parts " * 7, "zq", "漢字漢"]
    training = spark.createDataFrame([(t,) for t in train], "text string")
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    plain = [t.encode().lower() for t in train]
    want = [brute_score(plain, (t or "").encode().lower(), ppm.PpmSettings().order) for t in asked]
    for max_contexts in (1, 20, 300):
        got = ppm.scored(docs, training, settings=ppm.PpmSettings(max_contexts=max_contexts)).collect()
        assert len(got) == len(asked)
        for r in got:
            assert abs(r["score"] - want[r["doc_id"]]) < 1e-3, (max_contexts, asked[r["doc_id"]])


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = ppm.scored(docs, docs.select("text")).collect()
    assert len(rows) == 11
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    untrained = ppm.scored(docs, empty(spark).select("text")).collect()
    assert len(untrained) == 11 and all(r["n_known"] == r["train_tokens"] == 0 for r in untrained)
    null = next(r for r in untrained if r["doc_id"] == 5)
    assert abs(null["score"] + math.log10(257)) < 1e-6 and null["base_score"] == 0
    assert ppm.scored(empty(spark), docs.select("text")).count() == 0


def test_the_trie_is_built_in_little_more_than_its_tables(monkeypatch):
    """The driver builds it: counts, tails and shares of all contexts at once took several times its size."""
    monkeypatch.setattr(ppm, "_CHUNK", 256)
    letters = np.arange(160)
    pairs = (letters[:, None] << ppm.BITS | letters).reshape(-1)
    k = np.repeat([0, 1, 2], [len(letters), len(letters), len(pairs)])
    context = np.concatenate([np.zeros(len(letters), np.int64), letters, pairs])
    symbol = np.concatenate([letters, letters, np.resize(letters, len(pairs))])
    tracemalloc.start()
    model = ppm.model_of(k, context, symbol, np.ones(len(k), np.int64), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.logs.shape == (1 + len(letters) + len(pairs), len(letters) + 1)
    assert peak < 2 * model.logs.nbytes
