"""Screening events as lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = ["type", "progress", "message"]


def parse_event_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lift type, progress and message; the other fields stay as a variant `payload`.

    Lines that are no JSON object or have no text `type` are skipped, so a bad line never stops a stream.
    Works on batch and streaming DataFrames.
    """
    # The parser stops after the first value; inside an array, anything that follows it is an error.
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(line), F.lit("]")))
    lone = F.col(line).rlike(r"\}\s*$") & F.try_variant_get("_w", "$[1]", "variant").isNull()
    lifted = lines.withColumn("_w", wrapped).withColumn(
        "payload", F.when(lone, F.try_variant_get("_w", "$[0]", "variant"))
    )
    return lifted.select(
        *[c for c in lines.columns if c != line],
        F.try_variant_get("payload", "$.type", "string").alias("type"),
        F.coalesce(F.try_variant_get("payload", "$.progress", "int"), F.lit(0)).alias("progress"),
        F.coalesce(F.try_variant_get("payload", "$.message", "string"), F.lit("")).alias("message"),
        "payload",
    ).where(F.coalesce("type", F.lit("")) != "")


def field(path: str, dtype: str) -> Column:
    """A payload field, NULL where it is missing or of another type."""
    return F.try_variant_get("payload", path, dtype)


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def stream_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.readStream.text(path))


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON object per row, in a column `value`."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_event_lines(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)


def write_by_task(events: DataFrame, path: str, buckets: int = 256) -> None:
    """Every event under its task. Tasks share hash folders, so many tasks do not mean many tiny files."""
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("task_bucket")
    events.select("*", bucket).write.mode("append").partitionBy("task_bucket").parquet(path)


def read_task(spark: SparkSession, path: str, task_id: str, buckets: int = 256) -> DataFrame:
    """The events of one task, up to and including its first `done` or `error`."""
    bucket = F.pmod(F.xxhash64(F.lit(task_id)), F.lit(buckets))
    mine = spark.read.parquet(path).where((F.col("task_bucket") == bucket) & (F.col("task_id") == task_id))
    return until_end(mine).drop("task_bucket")


def until_end(events: DataFrame) -> DataFrame:
    """Drop events after the first `done` or `error` of their task."""
    ends = (
        events.where(F.col("type").isin("done", "error"))
        .groupBy("task_id")
        .agg(F.min("occurred_at").alias("_end"))
    )
    return (
        events.join(ends, "task_id", "left")
        .where(F.col("_end").isNull() | (F.col("occurred_at") <= F.col("_end")))
        .drop("_end")
    )
