"""Metrics over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.labels import label_string


def windowed_histograms(
    observations: DataFrame, edges: list[float], width: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Per (window, name, labels): cumulative count per edge as an array, sum and count.

    Rows later than the delay are dropped; a window is final once the watermark has passed its end.
    """
    value = F.col("value")
    cumulative = F.array(*[F.col(f"_{i}") for i in range(len(edges))])
    grouped = (
        observations.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "name", label_string(F.col("labels")).alias("labels"))
        .agg(
            *[F.count(F.when(value <= e, 1)).alias(f"_{i}") for i, e in enumerate(edges)],
            F.sum(value).alias("sum"),
            F.count(value).alias("count"),
        )
    )
    return grouped.select(
        F.col("window.start").alias("window_start"), "name", "labels", cumulative.alias("cumulative"), "sum", "count"
    )


def windowed_cost(costs: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Calls, tokens and cost per (window, model)."""
    return (
        costs.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "model_name")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(F.col("tokens_prompt") + F.col("tokens_completion")).alias("tokens"),
            F.sum("cost").alias("cost"),
        )
        .select(F.col("window.start").alias("window_start"), "model_name", "calls", "tokens", "cost")
    )


def first_sends(sends: DataFrame, hold: str = "24 hours") -> DataFrame:
    """First successful send per (candidate, job) within the hold time; nothing is ever released."""
    return sends.withWatermark("ts", hold).dropDuplicatesWithinWatermark(["candidate", "job"])
