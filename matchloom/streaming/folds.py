"""Folds of the event log, the same in batch and streaming: task status, live view, cost, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.sources.events import field


def current_status(updates: DataFrame) -> DataFrame:
    """Last status per task and the number of updates (append-only rows: task_id, status, updated_at)."""
    return updates.groupBy("task_id").agg(
        F.max_by("status", "updated_at").alias("status"),
        F.max("updated_at").alias("updated_at"),
        F.count(F.lit(1)).alias("updates"),
    )


def cost_rows(events: DataFrame) -> DataFrame:
    """Cost records from `cost` events; the task is the trace. A row-wise projection."""
    usage = events.where(F.col("type") == "cost")
    return usage.select(
        F.col("task_id").alias("trace_id"),
        field("$.usage.model_name", "string").alias("model_name"),
        F.coalesce(field("$.usage.tokens_prompt", "int"), F.lit(0)).alias("tokens_prompt"),
        F.coalesce(field("$.usage.tokens_completion", "int"), F.lit(0)).alias("tokens_completion"),
        F.coalesce(field("$.usage.cost", "double"), F.lit(0.0)).alias("cost"),
        "occurred_at",
    )


def live_view(events: DataFrame) -> DataFrame:
    """Per (task, candidate): counts of results and turns, last mean, std, report score and failure.

    Only events of a known candidate count. Values come from the newest event that carries them.
    """
    candidate = field("$.candidate_id", "string")
    rows = events.withColumn("candidate_id", candidate).where(F.col("candidate_id").isNotNull())

    def latest(value: Column, kind: str) -> Column:
        of_kind = F.col("type") == kind
        return F.max_by(F.when(of_kind, value), F.when(of_kind, F.col("occurred_at")))

    def seen(kind: str) -> Column:
        return F.count(F.when(F.col("type") == kind, 1))

    return rows.groupBy("task_id", "candidate_id").agg(
        seen("agent_result").alias("results"),
        seen("discussion").alias("turns"),
        latest(field("$.mean", "double"), "divergence").alias("mean"),
        latest(field("$.std", "double"), "divergence").alias("std"),
        latest(field("$.report.overall_score", "double"), "candidate_done").alias("overall_score"),
        latest(F.col("message"), "candidate_failed").alias("failed"),
        F.max("occurred_at").alias("last_event"),
    )


def task_outcome(events: DataFrame) -> DataFrame:
    """Per task: completed only once `done` was seen, results, cached results, events."""
    done = F.col("type") == "done"
    n_results = F.coalesce(F.size(field("$.results", "array<variant>")), F.lit(0))
    cached = (F.col("type") == "candidate_done") & F.coalesce(field("$.cached", "boolean"), F.lit(False))
    return events.groupBy("task_id").agg(
        F.when(F.bool_or(done), "completed").otherwise("failed").alias("status"),
        F.sum(F.when(done, n_results).otherwise(0)).alias("results"),
        F.count(F.when(cached, 1)).alias("cached"),
        F.count(F.lit(1)).alias("events"),
    )


def idle_tasks(events: DataFrame, now_ms: Column, idle_ms: int = 15_000) -> DataFrame:
    """Tasks that neither ended nor sent an event within the idle time."""
    last = events.groupBy("task_id").agg(
        F.max("occurred_at").alias("last_event"), F.bool_or(F.col("type").isin("done", "error")).alias("ended")
    )
    return last.where(~F.col("ended") & (now_ms - F.col("last_event") >= idle_ms)).select("task_id", "last_event")


def task_history(events: DataFrame) -> DataFrame:
    """First submission, first work and first end per task; `events`: task_id, id, ms, type.

    Minimums do not depend on the order of arrival, so late and repeated events do no harm.
    """
    kind = F.col("type")
    at = F.struct("ms", "id")
    ends = kind.isin("done", "error")
    return events.groupBy("task_id").agg(
        F.min(F.when(kind == "submitted", at)).alias("submitted"),
        F.min(F.when(~ends & (kind != "submitted"), at)).alias("worked"),
        F.min(F.when(ends, F.struct("ms", "id", "type"))).alias("ended"),
    )


def status_changes(history: DataFrame) -> DataFrame:
    """(task_id, ms, id, status): pending, running, then succeeded or failed; nothing follows an end."""

    def before(a: Column, b: Column) -> Column:
        later = (a["ms"] < b["ms"]) | ((a["ms"] == b["ms"]) & (a["id"] < b["id"]))
        return a.isNotNull() & (b.isNull() | later)

    submitted, worked, ended = F.col("submitted"), F.col("worked"), F.col("ended")

    def change(at: Column, when: Column, status: Column) -> Column:
        return F.when(when, F.struct(at["ms"].alias("ms"), at["id"].alias("id"), status.alias("status")))

    changes = F.array(
        change(submitted, before(submitted, worked) & before(submitted, ended), F.lit("pending")),
        change(worked, before(worked, ended), F.lit("running")),
        change(ended, ended.isNotNull(), F.when(ended["type"] == "done", "succeeded").otherwise("failed")),
    )
    known = F.filter(changes, lambda c: c.isNotNull())
    return history.select("task_id", F.explode(known).alias("c")).select("task_id", "c.*")


def last_saved(saves: DataFrame) -> DataFrame:
    """Last saved state per session; `saves`: session_id, id, ms, value."""
    return saves.groupBy("session_id").agg(
        F.max_by("value", F.struct("ms", "id")).alias("value"), F.max("ms").alias("saved")
    )


def readable_sessions(saved: DataFrame, now_ms: Column, ttl_ms: int = 86_400_000) -> DataFrame:
    """Sessions whose state is still within its time to live."""
    return saved.where(now_ms - F.col("saved") < ttl_ms)


def checkpoint_rows(events: DataFrame) -> DataFrame:
    """The events a retry needs later: finished reports and ends. A row-wise filter to append."""
    return events.where(F.col("type").isin("candidate_done", "done"))
