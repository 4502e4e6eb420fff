from collections import Counter

from pyspark.sql import functions as F

from matchloom.llm import sharding as sd
from tests.llm.helpers import awkward, empty


def brute_plan(counts, settings):
    """Arc by arc and round by round, one row at a time."""
    points, free = sd.ring_points(settings), sd.capacities(sum(counts.values()), settings)
    left, where = dict(sorted(counts.items())), Counter()
    step = 0
    while any(left.values()):
        for arc in left:
            shard = points[(arc + step) % len(points)][1]
            while left[arc] and free[shard]:
                left[arc] -= 1
                free[shard] -= 1
                where[arc, shard] += 1
        step += 1
    return where


def test_plan_is_that_of_brute_force():
    settings = sd.RingSettings(shards=5, virtual_nodes=4)
    counts = {a: (a * 13) % 11 for a in range(20)}
    got = Counter()
    for arc, start, end, shard, _ in sd.ring_plan(counts, settings):
        got[arc, shard] += end - start
    assert got == brute_plan(counts, settings)
    slack = sd.RingSettings(shards=5, virtual_nodes=4, slack=0.25)
    loads = Counter()
    for _, start, end, shard, _ in sd.ring_plan(counts, slack):
        loads[shard] += end - start
    assert max(loads.values()) <= -(-int(sum(counts.values()) * 1.25) // 5)


def place(spark, df, settings):
    return sd.shard_rows(df, "doc_id", settings).collect()


def test_rows_law_slots_and_movement(spark):
    rows = [(i, i % 9) for i in range(1200)] + [(None, 1)] * 150 + [(7, 7)] * 13
    df = spark.createDataFrame(rows, "doc_id long, size long")
    settings = sd.RingSettings(shards=12, virtual_nodes=32)
    got = place(spark, df, settings)
    loads = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(loads.values()) - min(loads.values()) <= 1 and len(loads) == 12
    for shard, n in loads.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert sorted(map(str, got)) == sorted(map(str, place(spark, df.orderBy(F.desc("size")), settings)))
    # with some slack most keys stay where they are when a shard is added; dealing by remainder would move 12 of 13
    loose = [sd.RingSettings(shards=n, virtual_nodes=32, slack=0.3) for n in (12, 13)]
    unique = df.where("doc_id <> 7")
    before, after = ({r["doc_id"]: r["shard"] for r in place(spark, unique, s)} for s in loose)
    assert sum(before[d] != after[d] for d in before) < 0.4 * len(before)


def test_arcs_follow_the_ring(spark):
    settings = sd.RingSettings(shards=3, virtual_nodes=5)
    places = [p for p, _ in sd.ring_points(settings)]
    asked = [0, (1 << 62) - 1, *places, *[p + 1 for p in places], *[p - 1 for p in places]]
    df = spark.createDataFrame([(p,) for p in asked], "p long")
    for row in sd.on_arcs(df, "p", settings).collect():
        assert row["__arc"] == next((i for i, p in enumerate(places) if p >= row["p"]), 0)


def test_awkward_rows(spark):
    settings = sd.RingSettings(shards=4, virtual_nodes=8)
    assert len(place(spark, awkward(spark), settings)) == 11
    assert place(spark, empty(spark), settings) == []
