"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at `virtual_nodes` points of a ring of 64-bit hashes. A key belongs to the first point clockwise
from its own hash; the keys between two points are an arc. Shards hold a bounded number of rows; keys that find their
shard full continue clockwise to the next point whose shard has room. Arcs are offered in rounds: first every arc
its own point, then what is left the next one, and so on, in ring order; so a key leaves its shard only if that is
full with keys of its own.

Which keys of an arc stay is settled by their order in it (hash, then key). So the plan needs the arcs' counts alone:
their number is that of the ring's points, whatever the data, and each key finds its shard and slot from its place in
its arc. Rows are shuffled once by arc, without texts.

Law `rows`: with `slack` 0 the capacities are the even shares, so that shards differ by one row at most. With more
slack a shard holds at most (1 + slack) times the mean, and fewer keys move. A null key has a hash like any other;
rows that repeat key, size and checksum are counted as one entry and get slots each. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.numbering import numbered
from matchloom.sources.staging import stage


@dataclass(frozen=True)
class RingSettings:
    shards: int = 40
    virtual_nodes: int = 64
    slack: float = 0.0


_BUCKET_BITS = 12  # the ring's points are looked up by the top bits of a hash


def ring_points(settings: RingSettings) -> list[tuple[int, int]]:
    """Sorted (place, shard), places from 0 to 2**62."""

    def place(shard: int, copy: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}/{copy}".encode()).digest()[:8], "big") >> 2

    return sorted((place(s, c), s) for s in range(settings.shards) for c in range(settings.virtual_nodes))


def ring_place(key: Column) -> Column:
    """Place of a key on the ring."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit("ring")), 2)


def capacities(rows: int, settings: RingSettings) -> list[int]:
    """Rows each shard may hold. Without slack: the even share, and one more for the first shards."""
    if settings.slack == 0:
        return [rows // settings.shards + (s < rows % settings.shards) for s in range(settings.shards)]
    most = -(-int(rows * (1 + settings.slack)) // settings.shards)
    return [max(most, -(-rows // settings.shards))] * settings.shards


def ring_plan(counts: dict[int, int], settings: RingSettings) -> list[tuple[int, int, int, int, int]]:
    """(arc, start, end, shard, first slot): where the entries of each arc go, from the number of rows per arc."""
    points = ring_points(settings)
    free = capacities(sum(counts.values()), settings)
    left = {arc: n for arc, n in sorted(counts.items()) if n}
    taken: dict[int, int] = dict.fromkeys(left, 0)
    slots = [0] * settings.shards
    plan = []
    step = 0
    while left:
        for arc in list(left):
            shard = points[(arc + step) % len(points)][1]
            n = min(left[arc], free[shard])
            if n:
                plan.append((arc, taken[arc], taken[arc] + n, shard, slots[shard]))
                taken[arc] += n
                slots[shard] += n
                free[shard] -= n
                left[arc] -= n
                if not left[arc]:
                    del left[arc]
        step += 1
    return plan


def _arcs(spark: SparkSession, settings: RingSettings) -> DataFrame:
    """(__bucket, __first, __places): arc numbers by the top bits of a place; one row per value of those bits."""
    places = [p for p, _ in ring_points(settings)]
    width = 62 - _BUCKET_BITS
    rows = []
    for bucket in range(1 << _BUCKET_BITS):
        first = bisect_left(places, bucket << width)
        rows.append((bucket, first, places[first : bisect_left(places, (bucket + 1) << width)]))
    schema = T.StructType(
        [
            T.StructField("__bucket", T.LongType()),
            T.StructField("__first", T.IntegerType()),
            T.StructField("__places", T.ArrayType(T.LongType())),
        ]
    )
    return spark.createDataFrame(rows, schema)


def on_arcs(df: DataFrame, place: str, settings: RingSettings) -> DataFrame:
    """Add `__arc`, the number of the first ring point at or after a row's place; the last arc wraps around to 0."""
    # bounded: 2**12 rows with the ring's points
    arcs = F.broadcast(_arcs(df.sparkSession, settings))
    joined = df.withColumn("__bucket", F.shiftrightunsigned(place, 62 - _BUCKET_BITS)).join(arcs, "__bucket")
    passed = F.size(F.filter("__places", lambda p: p < F.col(place)))
    points = settings.shards * settings.virtual_nodes
    return joined.withColumn("__arc", (F.col("__first") + passed) % points).drop("__bucket", "__first", "__places")


def shard_rows(df: DataFrame, key: str, settings: RingSettings = RingSettings()) -> DataFrame:
    """Add `shard` and `slot` (0, 1, 2 ... in each shard). Columns other than these stay; keep them few."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows = stage(on_arcs(df.select(*names, ring_place(F.col(key)).alias("__place")), "__place", settings), "ring-rows")
    counts = {r["__arc"]: r["count"] for r in rows.groupBy("__arc").count().collect()}  # one row per ring point
    plan = rows.sparkSession.createDataFrame(
        ring_plan(counts, settings), "__in int, __start bigint, __end bigint, shard int, __slot bigint"
    )
    placed = numbered(rows, "__arc", "__place", "__number")
    # bounded: an arc's rows go to few shards, the ring's points bound the arcs
    met = placed.join(F.broadcast(plan), (F.col("__arc") == F.col("__in")) & F.expr("__number >= __start AND __number < __end"))
    return met.select(*names, "shard", (F.col("__slot") + F.col("__number") - F.col("__start")).alias("slot"))
