"""Gapless numbers within groups of any size, by prefix sums over ranges of a random key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.staging import stage

KEY_BITS = 62


def numbered(rows: DataFrame, group: str, key: str, number: str = "place") -> DataFrame:
    """Add the column `number`, 0, 1, 2 ... within each group, in order of the key (0 to 2**62) and then all other columns.

    No group is sorted as a whole: a group's key ranges (about as many as rows stand in one) are counted, the counts
    summed up, and rows numbered within their range. Equal rows are counted once and take up that many numbers, so
    copies are no single task's work. `rows` should be stored or cheap, as it is read twice.
    """
    names = rows.columns
    total = rows.count()
    bits = max(1, (max(total, 1).bit_length() + 1) // 2)
    ranged = rows.withColumn("__range", F.shiftrightunsigned(key, KEY_BITS - bits))
    counted = ranged.groupBy("__range", *names).agg(F.count("*").alias("__copies"))
    sums = ranged.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        sums.withColumnsRenamed({group: "__g", "__range": "__r"}).withColumn(
            "__start", F.coalesce(F.sum("__n").over(before), F.lit(0))
        ),
        "starts",
    ).select("__g", "__r", "__start")
    inside = Window.partitionBy(group, "__range").orderBy(key, *[c for c in names if c not in (group, key)])
    within = counted.withColumn("__upto", F.sum("__copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = within.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    first = F.col("__start") + F.col("__upto") - F.col("__copies")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1))
    return placed.withColumn("__first", first).withColumn("__copy", copies).select(
        *names, (F.col("__first") + F.col("__copy")).alias(number)
    )
