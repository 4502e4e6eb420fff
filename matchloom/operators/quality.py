"""Validation rules: each adds a reason or lists violations, none raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed
from matchloom.settings import DEFAULTS


def candidate_limit(wanted: Column) -> Column:
    """Requested number of candidates, default 10, at most 50."""
    return F.least(F.coalesce(wanted, F.lit(DEFAULTS.max_candidates)), F.lit(DEFAULTS.max_candidates_cap))


def violations(*checks: tuple[Column, str]) -> Column:
    """Names of the failed checks as an array, in the given order."""
    found = F.array(*[F.when(bad, F.lit(name)) for bad, name in checks])
    return F.filter(found, lambda v: v.isNotNull())


def _panel_members(category: Column) -> Column:
    members = F.array(*[F.lit(a) for a in fixed.PANEL_WEIGHTS[fixed.DEFAULT_CATEGORY]])
    for name, weights in fixed.PANEL_WEIGHTS.items():
        members = F.when(category == name, F.array(*[F.lit(a) for a in weights])).otherwise(members)
    return members


def weight_violations(category: Column, weights: Column) -> Column:
    """Override weights: known experts only, each in (0, 1], sum in [0.99, 1.01]; no override is fine."""
    values = F.map_values(weights)
    total = F.aggregate(values, F.lit(0.0), lambda a, w: a + w)
    given = weights.isNotNull() & (F.size(F.map_keys(weights)) > 0)
    # Sums of decimal weights may miss a bound by a rounding error.
    checked = F.round(total, 9)
    return F.when(
        given,
        violations(
            (F.size(F.array_except(F.map_keys(weights), _panel_members(category))) > 0, "unknown_expert"),
            (F.exists(values, lambda w: (w <= 0) | (w > 1)), "weight_range"),
            ((checked < 0.99) | (checked > 1.01), "weight_sum"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def override_violations(overrides: Column) -> Column:
    """Screen overrides (JSON object text): allowed keys, values that are numbers or strings."""
    keys = F.coalesce(F.json_object_keys(overrides), F.array().cast("array<string>"))
    # A number or a string reads as a scalar; an object, array or boolean does not.
    values = F.from_json(overrides, "map<string,string>")
    bad = F.exists(
        F.map_values(F.coalesce(values, F.create_map().cast("map<string,string>"))),
        lambda v: v.isNull() | v.startswith("{") | v.startswith("[") | v.isin("true", "false"),
    )
    allowed = F.array(*[F.lit(k) for k in fixed.OVERRIDE_KEYS_ACCEPTED])
    return violations((F.size(F.array_except(keys, allowed)) > 0, "unknown_key"), (bad, "value_type"))


def feedback_violations(feedback: Column) -> Column:
    return violations((~F.coalesce(feedback, F.lit("")).isin(*fixed.FEEDBACK_KINDS), "feedback_kind"))


def request_violations(tenant: Column, job: Column, wanted: Column) -> Column:
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return violations(
        (missing(tenant), "tenant_missing"),
        (missing(job), "job_missing"),
        (wanted.isNotNull() & ~wanted.between(1, DEFAULTS.max_candidates_cap), "max_candidates"),
    )


def interview_violations(times: Column, email: Column) -> Column:
    n = F.coalesce(F.size(times), F.lit(0))
    return violations(
        (~n.between(1, 10), "proposed_times"), (F.coalesce(email, F.lit("")) == "", "email_missing")
    )


def split_by_violations(df: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    checked = df.withColumn("violations", reasons)
    return (
        checked.where(F.size("violations") == 0).drop("violations"),
        checked.where(F.size("violations") > 0),
    )


def histogram_violations(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms whose cumulative buckets fall or whose +Inf bucket differs from the count.

    `buckets`: keys, le (NULL is +Inf), cumulative, count. Few rows per key: one per edge.
    """
    order = F.array_sort(
        F.collect_list(
            F.struct(F.coalesce(F.col("le"), F.lit(float("inf"))).alias("le"), "cumulative")
        )
    )
    listed = buckets.groupBy(*keys).agg(
        order.alias("_b"), F.max(F.when(F.col("le").isNull(), F.col("cumulative"))).alias("_inf"),
        F.max("count").alias("count"),
    )
    n = F.size("_b")
    steps = F.zip_with(F.slice("_b", 1, n - 1), F.slice("_b", 2, n), lambda a, b: b["cumulative"] < a["cumulative"])
    falls = F.exists(steps, lambda s: F.coalesce(s, F.lit(False)))
    reasons = violations((falls, "not_monotone"), (F.col("_inf") != F.col("count"), "inf_not_count"))
    return listed.select(*keys, F.explode(reasons).alias("violation"))

