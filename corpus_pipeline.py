"""Documents to packed batches: quality rules, language, near copies, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bag_minhash, lang_id, mixing, packing, quality_rules
from matchloom.session import ship_package
from matchloom.sources.staging import stage


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality_rules.keep(docs)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a clear language, by a model learned from the labelled ones among them; all, if none is labelled."""
    return lang_id.reject_unclear(docs, lang_id.fit(docs))


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return bag_minhash.keep_one(docs)


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, whole; the one at a source's budget is taken if half of it fits."""
    return mixing.mixed(docs, quality_rules.count_words(F.col("text")))


def by_length(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length, with their texts."""
    return packing.pack_texts(docs, quality_rules.count_words(F.col("text")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", by_quality),
    ("language_id", by_language),
    ("near_copies", by_near_copies),
    ("mixture", by_mixture),
    ("packing", by_length),
]

# Near copies are found by random signatures and lengths are cut by dynamic programming: SQL does not express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written, and read again as the next one's input."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
