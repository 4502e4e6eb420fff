"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only where driver and tasks share one machine may it be unset."""
    global _local_dir
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError(f"set {_SETTING} to a folder that driver and executors share (master {master})")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="matchloom-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once, read many: cuts lineage, survives lost executors, gives real sizes to the optimizer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
