"""Tenant-scoped reads, lookups, JSON columns and appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.rules import strings


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """Use all cores for a stored table with fewer splits than there are cores; larger tables stay as they are.

    For text columns whose rows cost much to process. `table` is a plain scan: counting its splits runs no job.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def write_by_tenant(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stored by tenant, so a tenant's scan reads only its folder."""
    df.write.mode(mode).partitionBy("tenant_id").parquet(path)


def tenant_rows(df: DataFrame, tenant, created_at: str = "created_at") -> DataFrame:
    """All rows of a tenant, newest first."""
    return df.where(F.col("tenant_id") == F.lit(tenant)).orderBy(F.desc(created_at))


def lookup(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for the wanted keys, with `found` false where a key has none."""
    return wanted.select(*keys).distinct().join(df.withColumn("found", F.lit(True)), keys, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def decode_json(text: Column, dtype: T.DataType) -> Column:
    return F.from_json(text, dtype)


def decode_string_list(text: Column) -> Column:
    """JSON array of strings; NULL, bad JSON and other values become the empty array."""
    return strings(F.from_json(text, T.ArrayType(T.StringType())))


def encode_json(value: Column) -> Column:
    return F.to_json(value)


def encode_string_list(values: Column) -> Column:
    """NULL is written as `[]`."""
    return F.to_json(strings(values))


def with_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """Give rows without an id a random one; ids that are not text are complete already."""
    if name not in df.columns:
        return df.withColumn(name, F.uuid())
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df
    return df.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.uuid()))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def resolve_names(df: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """Add a display name: that of the referenced row, else the first eight characters of the id.

    `names` has one row per key.
    """
    return df.join(names.select(key, name), key, "left").withColumn(
        name, F.coalesce(F.col(name), F.substring(F.col(key).cast("string"), 1, 8))
    )
