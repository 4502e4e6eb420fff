"""Job history in long form: (keys, s, e) rows, one per job span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_years_long(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Total years per key, overlaps counted once: spans are cut into islands first.

    Of spans with the same start only the longest matters, so a key has at most one row per year.
    """
    spans = spans.groupBy(*keys, "s").agg(F.max("e").alias("e"))
    order = Window.partitionBy(*keys).orderBy("s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("s") > F.max("e").over(before), F.lit(True))
    islands = spans.withColumn("_opens", opens).withColumn(
        "_island", F.sum(F.col("_opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    lengths = islands.groupBy(*keys, "_island").agg((F.max("e") - F.min("s")).alias("_years"))
    return lengths.groupBy(*keys).agg(F.sum("_years").alias("years"))


def gaps_and_tenure(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Mean length of spans longer than 0 and the sum of gaps to the next span."""
    following = F.lead("s").over(Window.partitionBy(*keys).orderBy("s", "e"))
    gap = F.greatest(F.coalesce(following - F.col("e"), F.lit(0)), F.lit(0))
    return (
        spans.withColumn("_gap", gap)
        .groupBy(*keys)
        .agg(
            F.avg(F.when(F.col("e") > F.col("s"), F.col("e") - F.col("s"))).alias("mean_tenure"),
            F.sum("_gap").alias("gap_years"),
        )
    )
