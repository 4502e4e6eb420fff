"""Feedback: preference boosts, adjusted scores, candidates of high potential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import clamp
from matchloom.operators.ranking import top_k
from matchloom.operators.sequences import slots, stretches
from matchloom.settings import DEFAULTS


def preference_step(feedback: Column) -> Column:
    step = DEFAULTS.preference_delta
    return F.when(feedback == "suitable", step).when(feedback == "not_suitable", -step).otherwise(0.0)


def clamp_boost(total: Column) -> Column:
    """Clamped when read, not when summed."""
    return clamp(total, -DEFAULTS.preference_clamp, DEFAULTS.preference_clamp)


def preference_boosts(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, boost): sum of all feedback steps per user, clamped."""
    total = F.round(F.sum(preference_step(F.col("feedback"))), 6)
    return log.groupBy(*keys).agg(clamp_boost(total).alias("boost"))


def preference_slots(log: DataFrame, keys: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """(keys, _slot, _first, _last, _sum): steps per slot no longer than the time to live.

    A plain aggregate, so it also runs on a stream; hot users are summed map-side.
    """
    return slots(log, keys, ts, ttl_seconds, F.sum(preference_step(F.col("feedback"))).alias("_sum"))


def boosts_from_slots(
    slot_rows: DataFrame, keys: list[str], ttl_seconds: int, as_of: Column | None = None
) -> DataFrame:
    """(keys, last_feedback, boost): the sum over the last stretch without a pause of the time to live.

    With `as_of`, users whose last feedback is older than the time to live drop out.
    """
    sums = (
        stretches(slot_rows, keys, ttl_seconds)
        .groupBy(*keys, "_stretch")
        .agg(F.sum("_sum").alias("_sum"), F.max("_last").alias("_last"))
    )
    latest = sums.groupBy(*keys).agg(F.max(F.struct("_stretch", "_sum", "_last")).alias("_l"))
    if as_of is not None:
        latest = latest.where(as_of - F.col("_l._last") < ttl_seconds)
    return latest.select(
        *keys, F.col("_l._last").alias("last_feedback"), clamp_boost(F.round("_l._sum", 6)).alias("boost")
    )


def expiring_boosts(
    log: DataFrame, keys: list[str], ts: str, ttl_seconds: int, as_of: Column | None = None
) -> DataFrame:
    """Boost with a time to live that every feedback renews. `ts` is in seconds."""
    return boosts_from_slots(preference_slots(log, keys, ts, ttl_seconds), keys, ttl_seconds, as_of)


def adjusted_score(score: Column, boost: Column, digits: int = 2) -> Column:
    """score * (1 + boost), within 0..100."""
    return F.round(clamp(score * (1.0 + F.coalesce(boost, F.lit(0.0))), 0, 100), digits)


def with_boost(results: DataFrame, boosts: DataFrame, keys: list[str], digits: int = 2) -> DataFrame:
    """Results as a user sees them: adjusted at read time, never stored."""
    joined = results.join(boosts, keys, "left")
    return joined.withColumn("adjusted_score", adjusted_score(F.col("overall_score"), F.col("boost"), digits))


def display_order(results: DataFrame, raw: bool = False) -> DataFrame:
    """A result list for display: by adjusted score where there is one, or by the raw score."""
    shown = F.col("overall_score") if raw else F.coalesce("adjusted_score", "overall_score")
    return results.orderBy(shown.desc(), F.asc("candidate_id"))


def high_potential(log: DataFrame, jobs: DataFrame, limit: int = 5) -> DataFrame:
    """(tenant, job, rank, target): first `limit` targets ever found suitable and not refused for the job.

    The tenant's suitable targets are numbered once; a job then takes the first numbers that its own
    refusals leave free, found from the gaps between them. No job meets targets it does not list.
    """
    suitable = log.where(F.col("feedback") == "suitable").select("tenant_id", "target_id").distinct()
    refused = (
        log.where(F.col("feedback") == "not_suitable")
        .select("tenant_id", "job_id", "target_id")
        .distinct()
        .join(suitable, ["tenant_id", "target_id"], "left_semi")
    )
    most = refused.groupBy("tenant_id", "job_id").count().agg(F.max("count")).first()[0] or 0
    numbered = top_k(suitable, ["tenant_id"], [F.asc("target_id")], limit + most, "_no")
    taken = refused.join(numbered, ["tenant_id", "target_id"]).select("tenant_id", "job_id", F.col("_no").alias("_hi"))
    # Open end after the last refusal; a job without refusals has just that.
    ends = jobs.select("tenant_id", "job_id").distinct().withColumn("_hi", F.lit(limit + most + 1))
    by_number = Window.partitionBy("tenant_id", "job_id").orderBy("_hi")
    gaps = (
        taken.unionByName(ends)
        .withColumn("_lo", F.coalesce(F.lag("_hi").over(by_number), F.lit(0)) + 1)
        .withColumn("_before", F.col("_lo") - F.row_number().over(by_number))
        .where((F.col("_before") < limit) & (F.col("_lo") < F.col("_hi")))
    )
    last = F.least(F.col("_hi") - 1, F.col("_lo") + limit - F.col("_before") - 1)
    picks = gaps.select("tenant_id", "job_id", "_lo", "_before", F.explode(F.sequence("_lo", last)).alias("_no"))
    return picks.join(numbered, ["tenant_id", "_no"]).select(
        "tenant_id", "job_id", (F.col("_before") + F.col("_no") - F.col("_lo") + 1).alias("rank"), "target_id"
    )
