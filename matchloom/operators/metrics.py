"""Cost, token, latency and request metrics over observation rows (name, labels, value, ts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom import fixed
from matchloom.functions.labels import counter_name, edge_text, label_string, with_label
from matchloom.settings import DEFAULTS

# --- cost ---


def call_cost(prompt: Column, completion: Column, settings=DEFAULTS) -> Column:
    """US dollars of one model call."""
    per_m = 1_000_000.0
    return prompt / per_m * settings.price_prompt_per_m + completion / per_m * settings.price_completion_per_m


def cost_by_model(costs: DataFrame, keys: list[str]) -> DataFrame:
    return costs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_prompt").alias("prompt_tokens"),
        F.sum("tokens_completion").alias("completion_tokens"),
        F.sum("cost").alias("total_cost"),
    )


def cost_totals(costs: DataFrame) -> DataFrame:
    """Total cost and tokens; 0 for an empty table."""
    tokens = F.col("tokens_prompt") + F.col("tokens_completion")
    return costs.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens"),
    )


def running_cost(costs: DataFrame, key: str = "trace_id") -> DataFrame:
    tokens = F.col("tokens_prompt") + F.col("tokens_completion")
    return costs.groupBy(key).agg(F.sum(tokens).alias("tokens"), F.sum("cost").alias("usd"))


def tasks_by_status(tasks: DataFrame) -> DataFrame:
    """(status, n) for all four statuses, also those no task has."""
    counts = tasks.agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in fixed.TASK_STATUSES]
    )
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in fixed.TASK_STATUSES])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def stored_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n): rows per stored table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


# --- counters, gauges, histograms ---


def counters(observations: DataFrame) -> DataFrame:
    """(name, labels, value): sums per label set, labels as sorted text."""
    return observations.groupBy("name", label_string(F.col("labels")).alias("labels")).agg(
        F.sum("value").alias("value")
    )


def gauges(observations: DataFrame) -> DataFrame:
    """Last value per label set; of equal times the greatest value."""
    last = F.max(F.struct("ts", "value"))
    return observations.groupBy("name", label_string(F.col("labels")).alias("labels")).agg(
        last["value"].alias("value")
    )


def first_edge(value: Column, edges: list[float]) -> Column:
    """The bucket of a value: first edge that is not below it, NULL beyond the last."""
    return F.get(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: value <= e), F.lit(0))


def bucket_counts(observations: DataFrame, edges: list[float]) -> DataFrame:
    """(name, labels, le, n): observations per bucket, overflow under NULL."""
    return observations.groupBy(
        "name",
        label_string(F.col("labels")).alias("labels"),
        first_edge(F.col("value"), edges).alias("le"),
    ).agg(F.count(F.lit(1)).alias("n"))


def histograms(observations: DataFrame, edges: list[float]) -> DataFrame:
    """(name, labels, le, cumulative, sum, count), one row per edge and one for +Inf (le NULL).

    The cumulative counts are aggregates of the one pass over the rows, so empty buckets need no join.
    """
    value = F.col("value")
    aggregates = [F.count(F.when(value <= e, 1)).alias(f"_{i}") for i, e in enumerate(edges)]
    wide = observations.groupBy("name", label_string(F.col("labels")).alias("labels")).agg(
        *aggregates, F.sum(value).alias("sum"), F.count(value).alias("count")
    )
    rows = [
        F.struct(F.lit(e).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, e in enumerate(edges)
    ] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("count").alias("cumulative"))]
    return wide.select("name", "labels", "sum", "count", F.explode(F.array(*rows)).alias("b")).select(
        "name", "labels", "b.le", "b.cumulative", "sum", "count"
    )


def cumulate(buckets: DataFrame, edges: list[float]) -> DataFrame:
    """Running sums over stored bucket counts (name, labels, le, n); missing edges count 0."""
    keys = ["name", "labels"]
    filled = buckets.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("le") == e, F.col("n"))), F.lit(0)).alias(f"_{i}") for i, e in enumerate(edges)],
        F.coalesce(F.sum(F.when(F.col("le").isNull(), F.col("n"))), F.lit(0)).alias("_over"),
    )
    rows = [F.struct(F.lit(e).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_over").alias("n")))
    by_edge = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("le")).rowsBetween(Window.unboundedPreceding, 0)
    long = filled.select(*keys, F.explode(F.array(*rows)).alias("b")).select(*keys, "b.le", "b.n")
    return long.select(*keys, "le", F.sum("n").over(by_edge).alias("cumulative"))


def snapshot(observations: DataFrame, digits: int = 4) -> DataFrame:
    """Count, sum and mean per label set."""
    return observations.groupBy("name", label_string(F.col("labels")).alias("labels")).agg(
        F.count("value").alias("count"),
        F.round(F.sum("value"), digits).alias("sum"),
        F.round(F.avg("value"), digits).alias("avg"),
    )


def stage_timings(timings: DataFrame, keys: list[str], accuracy: int = 10_000) -> DataFrame:
    """Count, mean, P50 and P95 of stage times."""
    return timings.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.percentile_approx("value", 0.5, accuracy).alias("p50"),
        F.percentile_approx("value", 0.95, accuracy).alias("p95"),
    )


# --- derived observation rows ---


def route_label(path: Column) -> Column:
    """Route template of a path: ids become `:id`; no path is `unmatched`."""
    template = F.regexp_replace(path, r"/(?:[0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(?=/|$)", "/:id")
    return F.coalesce(F.nullif(template, F.lit("")), F.lit("unmatched"))


def observation(name: str, value: Column, ts: Column, **labels: Column) -> list[Column]:
    """Columns of an observation row."""
    pairs = [x for key, col in labels.items() for x in (F.lit(key), col.cast("string"))]
    tags = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return [F.lit(name).alias("name"), tags.alias("labels"), value.cast("double").alias("value"), ts.alias("ts")]


# --- text export ---


def _number(value: Column) -> Column:
    """Without needless decimals, six digits at most."""
    return F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(
        F.regexp_replace(F.format_string("%.6f", value), r"0+$", "")
    )


def export_counters(rows: DataFrame) -> DataFrame:
    line = F.concat(counter_name(F.col("name")), "labels", F.lit(" "), _number(F.col("value")))
    return rows.select(line.alias("line"))


def export_gauges(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat("name", "labels", F.lit(" "), _number(F.col("value"))).alias("line"))


def export_histograms(rows: DataFrame) -> DataFrame:
    """`_bucket` lines per edge, then `_sum` and `_count`, from `histograms`."""
    bucket = F.concat(
        "name", F.lit("_bucket"), with_label(F.col("labels"), "le", edge_text(F.col("le"))),
        F.lit(" "), F.col("cumulative").cast("string"),
    )
    total = F.concat("name", F.lit("_sum"), "labels", F.lit(" "), F.format_string("%.6f", F.col("sum")))
    count = F.concat("name", F.lit("_count"), "labels", F.lit(" "), F.col("count").cast("string"))
    lines = F.when(F.col("le").isNull(), F.array(bucket, total, count)).otherwise(F.array(bucket))
    return rows.select(F.explode(lines).alias("line"))


# --- totals of tasks, calls and screenings ---


def results_of_tasks(results: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """(tenant, task, n, best) of stored results; only of the given (tenant, task) rows if there are any given."""
    keys = ["tenant_id", "task_id"]
    rows = results if tasks is None else results.join(tasks.select(*keys).distinct(), keys, "left_semi")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("overall_score").alias("best"))


def rows_by_tenant(df: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    return df.groupBy(F.col(tenant).alias("tenant_id")).agg(F.count(F.lit(1)).alias("n"))


def model_calls(calls: DataFrame) -> DataFrame:
    """Per (model, kind, status): calls, tokens, cost and seconds of model calls.

    calls: model, kind, status, tokens, cost, seconds.
    """
    return calls.groupBy("model", "kind", "status").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.sum("seconds").alias("seconds"),
    )


def screening_totals(tasks: DataFrame) -> DataFrame:
    """Per (completed, cached): screenings and their candidates. tasks: status, cached, candidates."""
    return tasks.groupBy((F.col("status") == "succeeded").alias("completed"), "cached").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("candidates").alias("candidates")
    )


def task_metrics(tasks: DataFrame) -> DataFrame:
    """Per status: tasks, seconds, fine candidates, cache hits, misses and retries.

    tasks: status, seconds, fine_candidates, cache_hits, retries; misses are the candidates without a hit.
    """
    return tasks.groupBy("status").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum("seconds").alias("seconds"),
        F.sum("fine_candidates").alias("fine_candidates"),
        F.sum("cache_hits").alias("cache_hits"),
        F.sum(F.col("fine_candidates") - F.col("cache_hits")).alias("cache_misses"),
        F.sum("retries").alias("retries"),
    )


# --- rates ---


def requests_in_window(
    requests: DataFrame, keys: list[str], ts: str, tie: str, span: int, bucket_spans: int = 60
) -> DataFrame:
    """Requests of the same caller in (ts - span, ts], `ts` being a whole number.

    Windows run per (caller, time bucket); rows of the last `span` before a bucket are copied into it, so a
    caller with very many requests is counted by many tasks.
    """
    width = span * bucket_spans
    bucket = F.floor(F.col(ts) / width)
    after = F.floor((F.col(ts) + (span - 1)) / width)
    copies = F.when(after > bucket, F.array(bucket, after)).otherwise(F.array(bucket))
    spread = requests.withColumn("_own", bucket).withColumn("_bucket", F.explode(copies))
    frame = Window.partitionBy(*keys, "_bucket").orderBy(ts).rangeBetween(-(span - 1), 0)
    counted = spread.withColumn("in_window", F.count(F.lit(1)).over(frame))
    return counted.where(F.col("_own") == F.col("_bucket")).drop("_own", "_bucket")
