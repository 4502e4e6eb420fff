"""Resume files: extension, size and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import fixed


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def reject_reason(path: Column, length: Column, content: Column, max_bytes: int) -> Column:
    """First failed check, NULL for an acceptable file."""
    ext = extension(path)
    known = ext.isin(*[e for e, _ in fixed.FILE_SIGNATURES])
    signature = F.lit(False)
    for name, lead in fixed.FILE_SIGNATURES:
        starts = F.hex(F.substring(content, 1, len(lead) // 2)) == lead
        signature = F.when(ext == name, starts).otherwise(signature)
    return (
        F.when(~known, "extension")
        .when(length > max_bytes, "too_large")
        .when(length < 8, "too_short")
        .when(~signature, "signature")
    )


def accepted_files(files: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(accepted files, rejected files with the reason)."""
    checked = files.withColumn(
        "reason", reject_reason(F.col("path"), F.col("length"), F.col("content"), max_bytes)
    )
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL").drop("content")
