"""Shape of a screening request: candidate payloads and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_payload(candidates: DataFrame) -> DataFrame:
    """candidate_id, resume_text and structured_json (`{}` where there is no profile)."""
    return candidates.select(
        "candidate_id", "resume_text", F.coalesce(F.to_json("structured"), F.lit("{}")).alias("structured_json")
    )


def flatten_batches(requests: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate of a request: its batches if it has any that are not empty, else its list."""
    full = F.filter("batches", lambda b: F.size(b) > 0)
    several = F.coalesce(F.size(full) > 0, F.lit(False))
    lists = F.when(several, full).otherwise(F.array("candidates"))
    batched = requests.select(*keys, F.posexplode(lists).alias("batch", "_members"))
    return batched.select(*keys, "batch", F.explode("_members").alias("candidate"))
