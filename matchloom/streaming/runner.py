"""Starting streams: shared checkpoint folders, retry-safe sinks, state store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchloom.sources.staging import new_path

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need the RocksDB store; state then lives on disk, not on the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != _PROVIDER:
        spark.conf.set(key, _PROVIDER)


def append_to(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Exactly-once append to parquet."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def updates_to(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Changed aggregate rows, one folder per batch; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every row that `updates_to` wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*")


def drain(df: DataFrame, label: str) -> DataFrame:
    """Run an append stream over everything that is there now and read its output."""
    spark = df.sparkSession
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    append_to(df, path, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def drain_updates(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    spark = df.sparkSession
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    updates_to(df, path, checkpoint).awaitTermination()
    return latest_updates(spark, path, keys)


def results_then_status(
    write_results: Callable[[DataFrame], None], write_status: Callable[[DataFrame], None]
) -> Callable[[DataFrame, int], None]:
    """Batch function that stores results before it reports tasks as done."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_results(batch.where(F.col("type") == "candidate_done"))
        write_status(batch.where(F.col("type").isin("done", "error")))

    return handle
