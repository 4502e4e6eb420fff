"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.tables import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

SPREAD_TABLES = ("documents", "lineitem")  # costly rows, stored in few files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given parquet tables of one scale factor, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in SPREAD_TABLES else table

    @cached_property
    def views(self):
        from workload.entities import Entities

        return Entities(self)


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under a name, with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register
