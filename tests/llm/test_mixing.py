from pyspark.sql import functions as F

from matchloom.llm import mixing as mx
from matchloom.llm import quality_rules as q
from tests.llm.helpers import awkward, empty


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Pass the excess on until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    limit = {s: most * sizes[s] for s in names}
    total, at = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in at]
        rest = total - sum(limit[s] for s in at)
        target = {s: limit[s] if s in at else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if target[s] > limit[s]}
        if not above:
            return target
        at |= above


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    kept = mx.taken(*mx.mix_plan(df))
    return kept.withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).collect()


def rows_of(n):
    out = [(i, ("a", "b", "é", "Z", None)[i % 5], 1 + (i * 7919) % 53) for i in range(n)]
    return out + [(10_000 + i, "hot", 40) for i in range(n)] + [(20_000, "tiny", 1), (20_001, "none", 0)]


def test_budgets_and_order(spark):
    rows = rows_of(300)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    got = run(spark, rows)
    assert len(got) == len(rows)
    per = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]] = per.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert per[s] == round(want[s]), s  # exact in whole words
    # in each source the documents in front of the cut have one copy more than those behind it
    for s in sizes:
        keys = sorted((r["key"], r["doc_id"], r["size"], r["whole"], r["part"]) for r in got if r["source"] == s and r["size"])
        copies = [w for *_, w, _ in keys]
        assert copies == sorted(copies, reverse=True)
        assert sum(p > 0 for *_, p in keys) <= 1
    assert sorted(map(str, got)) == sorted(map(str, run(spark, rows[::-1])))


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", 10)] * 7 + [(None, "a", 3)] * 9 + [(5, "b", 100)]
    got = run(spark, rows)
    want = brute_targets({"a": 97, "b": 100})
    for s in ("a", "b"):
        assert sum(r["taken"] for r in got if r["source"] == s) == round(want[s])
    assert len(got) == len(rows)


def test_mixture_rows(spark):
    docs = awkward(spark)
    words = q.words_of(F.col("text"))
    out = mx.mixed(docs, F.size(words).cast("long"))
    assert out.columns == docs.columns
    got = sum(len((r["text"] or "").split()) for r in out.collect())
    total = sum(len((r["text"] or "").split()) for r in docs.collect())
    whole = {r["text"] for r in docs.collect()}
    assert {r["text"] for r in out.collect()} <= whole  # no text is cut
    assert got <= 2 * total
    assert mx.mixed(empty(spark), F.size(words).cast("long")).count() == 0
    assert run(spark, []) == []


def test_nothing_to_take(spark):
    assert [r["taken"] for r in run(spark, [(1, "a", 0), (2, None, 0)])] == [0, 0]
