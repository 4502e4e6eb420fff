import itertools
import random

from pyspark.sql import functions as F

from matchloom.llm import packing as pk
from matchloom.llm import quality_rules as q
from matchloom.llm.numbering import numbered
from tests.llm.helpers import awkward, empty


def padding(histogram, ends):
    return sum((min(e for e in ends if e >= length) - length) * n for length, n in histogram)


def test_boundaries_are_the_best_ones():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 9)))
        histogram = [(x, rng.randint(1, 30)) for x in lengths]
        for buckets in (1, 2, 3, 5, 12):
            ends = pk.boundaries(histogram, buckets)
            assert len(ends) <= buckets and ends[-1] == lengths[-1]
            best = min(
                padding(histogram, [*some, lengths[-1]])
                for k in range(min(buckets, len(lengths)))
                for some in itertools.combinations(lengths[:-1], k)
            )
            assert padding(histogram, ends) == best
    assert pk.boundaries([], 4) == []


def test_batches(spark):
    rows = [(i, (i * 7919) % 300) for i in range(900)] + [(5000, 9000), (5001, 0)] + [(None, 17)] * 50 + [(7, 17)] * 3
    df = spark.createDataFrame(rows, "doc_id long, length long")
    settings = pk.PackSettings(buckets=6, batch_tokens=1000)
    got = pk.pack(df, F.col("length"), settings).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == sorted((str(d), n) for d, n in rows)
    histogram = sorted({n: sum(m == n for _, m in rows) for _, n in rows}.items())
    ends = pk.boundaries(histogram, 6)
    batches = {}
    for r in got:
        assert r["padded"] == ends[r["bucket"]] >= r["length"]
        assert r["bucket"] == 0 or ends[r["bucket"] - 1] < r["length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), members in batches.items():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * ends[bucket] <= 1000
        full = max(1, 1000 // max(1, ends[bucket]))
        assert len(members) == full or (bucket, batch + 1) not in batches
    again = pk.pack(df.orderBy(F.desc("length")), F.col("length"), settings).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_numbers_are_gapless(spark):
    rows = [(i % 3 if i % 3 else None, (i * 2654435761) % (1 << 62), i % 10) for i in range(500)] + [(1, 77, 5)] * 40
    df = spark.createDataFrame(rows, "g long, k long, v long")
    got = numbered(df, "g", "k").collect()
    for group in (None, 1, 2):
        own = sorted((r["place"], r["k"], r["v"]) for r in got if r["g"] == group)
        assert [p for p, *_ in own] == list(range(len(own)))
        assert [(k, v) for _, k, v in own] == sorted((k, v) for g, k, v in rows if g == group)


def test_awkward_rows(spark):
    length = q.count_words(F.col("text"))
    assert pk.pack(awkward(spark), length).count() == 11
    assert pk.pack(empty(spark), length).count() == 0
