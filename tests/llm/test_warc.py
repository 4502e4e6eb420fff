import hashlib

from pyspark.sql import functions as F

from matchloom.llm import warc

SCHEMA = "archive string, offset long, content string, record_id long, hash string"
SMALL = warc.AuditSettings(range_bytes=100, fanout=3)


def records(spark, rows):
    return spark.createDataFrame([(a, o, c, i, "clash") for a, o, c, i in rows], SCHEMA)


def some(n=200):
    return [(f"f{i % 3}", 37 * (i // 3), f"content {i}", i) for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_damage_is_found_and_nothing_else(spark):
    ours = some()
    theirs = [r for r in ours if r[3] not in (10, 150)]
    theirs = [(a, o, c + "!", i) if i in (3, 77, 199) else (a, o, c, i) for a, o, c, i in theirs]
    theirs += [("f1", 99_999, "more", 900), ("f9", 0, "new file", 901)]
    got = {(r["archive"], r["offset"]): r for r in warc.audit(records(spark, ours), records(spark, theirs), SMALL).collect()}
    a, b = ({(x[0], x[1]): x for x in rows} for rows in (ours, theirs))
    want = {k: "missing" if k not in b else "extra" if k not in a else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert {k: r["kind"] for k, r in got.items()} == want
    for k, r in got.items():
        assert r["hash_ours"] == (sha(a[k][2]) if k in a else None)
        assert r["hash_theirs"] == (sha(b[k][2]) if k in b else None)
        assert r["record_id"] == (a.get(k) or b.get(k))[3]


def test_tree_is_that_of_brute_force(spark):
    rows = some(60)
    hashed = warc.hashed(records(spark, rows), SMALL)
    height = warc.height_of(hashed, settings=SMALL)
    levels = warc.tree(hashed, height, SMALL)
    nodes = {}
    for a, o, c, _ in sorted(rows):
        nodes.setdefault((a, o // 100), []).append(f"{o} {sha(c)} 1")
    nodes = {k: sha(" ".join(v)) for k, v in nodes.items()}
    for level in range(height):
        grouped = {}
        for (a, i), h in sorted(nodes.items()):
            grouped.setdefault((a, i // 3), []).append(f"{a}/{level}/{i}:{h}")
        nodes = {k: sha(" ".join(v)) for k, v in grouped.items()}
    named = {f"{a}/{height}/0": ("#" + hashlib.md5(a.encode()).hexdigest()[:4], h) for (a, _), h in nodes.items()}
    for digits in (4, 2, 0):
        grouped = {}
        for path, (up, h) in sorted(named.items()):
            grouped.setdefault(up[: 1 + digits], []).append(f"{path}:{h}")
        named = {up: (up, sha(" ".join(v))) for up, v in grouped.items()}
    assert warc.root_of(levels) == named["#"][1]


def test_only_differing_branches_are_looked_at(spark):
    ours = some()
    theirs = [(a, o, "bad" if i == 100 else c, i) for a, o, c, i in ours]
    a, b = (warc.hashed(records(spark, x), SMALL) for x in (ours, theirs))
    height = warc.height_of(a, b, settings=SMALL)
    bad = warc.differing(warc.tree(a, height, SMALL), warc.tree(b, height, SMALL))
    assert [r["path"] for r in bad.collect()] == [f"f1/0/{37 * 33 // 100}"]
    assert warc.audit(records(spark, ours), records(spark, ours[::-1]), SMALL).count() == 0


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (None, None, "", 1), ("a", 0, "x", 2), ("a", 0, "x", 2), ("a", 0, "y", 3), ("b", -5, "z", None)]
    full, none = records(spark, rows), records(spark, [])
    assert warc.audit(full, full, SMALL).count() == 0
    got = warc.audit(full, records(spark, [*rows[:2], *rows[3:]]), SMALL).collect()  # one copy less
    assert [(r["archive"], r["offset"], r["kind"]) for r in got] == [("a", 0, "changed")]
    assert {r["kind"] for r in warc.audit(full, none, SMALL).collect()} == {"missing"}
    assert {r["kind"] for r in warc.audit(none, full, SMALL).collect()} == {"extra"}
    assert warc.audit(none, none, SMALL).count() == 0


def test_layout(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "é" * (i % 50)) for i in range(100)] + [(None, None, None)], "record_id long, url string, html string")
    made = pages.select("record_id", warc.record_of(F.col("url"), F.col("html"), F.col("record_id")).alias("content"))
    laid = warc.lay_out(made, 4_000).collect()
    for archive in {r["archive"] for r in laid}:
        at = 0
        for r in sorted((r for r in laid if r["archive"] == archive), key=lambda r: (r["record_id"] is not None, r["record_id"])):
            assert r["offset"] == at
            at += len(r["content"].encode())
            head, body = r["content"].encode().split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.0\r\n") and f"Content-Length: {len(body) - 4}".encode() in head
