"""Queries: the event log as a stream, keyed state, event-time windows.

Each query streams over the whole given table with an available-now trigger and returns what it wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed
from matchloom.operators import feedback, incremental, sequences
from matchloom.sources import events as E
from matchloom.streaming import folds, state, windows
from matchloom.streaming.runner import drain, drain_updates
from workload.analytics import FEEDBACK
from workload.entities import micros
from workload.ingest import LOG, event_log
from workload.registry import Tables, query


BATCH_BYTES = 4 << 30


class StreamedTables(Tables):
    """The same tables, read as streams."""

    def __getattr__(self, name: str):
        batch = super().__getattr__(name)
        # The byte limit bounds a batch when the table has many files.
        reader = self.spark.readStream.schema(batch.schema).option("maxBytesPerTrigger", str(BATCH_BYTES))
        return reader.parquet(f"{self.sf_dir}/{name}*.parquet")


def stream(t) -> StreamedTables:
    return StreamedTables(t.spark, t.sf_dir)


def covering(log) -> str:
    """A delay as long as the stored log, so that no row of its stream is left out."""
    first, last = log.agg(F.min("ms"), F.max("ms")).first()
    return f"{(last or 0) - (first or 0) + 1} milliseconds"


def in_time_order(answers, log, keys, log_form):
    """The stream's answers; keys of which rows came late are settled from the stored log."""
    late = answers.where("late").select(*keys).distinct()
    again = log_form(log.join(late, keys, "left_semi")).select(*answers.drop("late").columns)
    return answers.join(late, keys, "left_anti").drop("late").unionByName(again)


MONTH_END_MS = 1704067200000 + 30 * 86_400_000


def _ms():
    return F.floor(micros(F.col("ts")) / 1000).alias("ms")


def _timestamp():
    return F.timestamp_micros(micros(F.col("ts"))).alias("ts")


# --- stateless: parse, route, cost ---


@query(
    "t1_event_routing",
    f"WITH {LOG} SELECT event_id, type, progress, message, candidate_id FROM log WHERE type IN ('view', 'error')",
)
def _(t):
    parsed = E.parse_event_lines(event_log(stream(t)))
    routed = parsed.where(F.col("type").isin("view", "error")).select(
        "event_id", "type", "progress", "message", E.field("$.candidate_id", "bigint").alias("candidate_id")
    )
    return drain(routed, "routed")


def screening_events(t):
    """Events under the names of the screening log: purchases are costs, signups finish candidates."""
    names = {"purchase": "cost", "signup": "candidate_done", "view": "agent_result", "click": "discussion", "error": "error"}
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    parsed = E.parse_event_lines(event_log(t))
    return parsed.withColumn("type", F.try_element_at(kind, F.col("type")))


@query(
    "t4_cost_stream",
    f"""
WITH {LOG}
SELECT task_id AS trace_id, 'purchase' AS model_name, tokens_prompt, 0 AS tokens_completion, cost, occurred_at FROM log WHERE type = 'purchase'
""",
)
def _(t):
    return drain(folds.cost_rows(screening_events(stream(t))), "costs")


# --- folds in update mode ---


@query(
    "t2_live_view",
    f"""
WITH {LOG}
SELECT task_id, candidate_id::VARCHAR AS candidate_id, count(CASE WHEN type = 'view' THEN 1 END) AS results,
       count(CASE WHEN type = 'click' THEN 1 END) AS turns, max(occurred_at) AS last_event
FROM log GROUP BY ALL
""",
)
def _(t):
    view = folds.live_view(screening_events(stream(t)))
    rows = drain_updates(view, "live-view", ["task_id", "candidate_id"])
    return rows.select("task_id", "candidate_id", "results", "turns", "last_event")


@query(
    "t12_task_outcomes",
    f"""
WITH {LOG}
SELECT task_id, CASE WHEN bool_or(type = 'purchase') THEN 'completed' ELSE 'failed' END AS status, count(*) AS events FROM log GROUP BY ALL
""",
)
def _(t):
    parsed = E.parse_event_lines(event_log(stream(t)))
    named = parsed.withColumn("type", F.when(F.col("type") == "purchase", "done").otherwise(F.col("type")))
    rows = drain_updates(folds.task_outcome(named), "outcomes", ["task_id"])
    return rows.select("task_id", "status", "events")


@query(
    "t11_idle_tasks",
    f"""
WITH {LOG}
SELECT task_id, max(occurred_at) AS last_event FROM log GROUP BY ALL
HAVING NOT bool_or(type = 'signup' AND event_id % 7 = 0 AND occurred_at > 1704067200000 + 25 * 86400000::BIGINT)
   AND 1704067200000 + 30 * 86400000::BIGINT - max(occurred_at) >= 15000
""",
)
def _(t):
    # Some signups in the last days end their task.
    late = (F.col("type") == "signup") & (F.col("event_id") % 7 == 0) & (F.col("occurred_at") > 1704067200000 + 25 * 86400000)
    named = E.parse_event_lines(event_log(t)).withColumn("type", F.when(late, "done").otherwise("stage"))
    return folds.idle_tasks(named, F.lit(1704067200000 + 30 * 86400000))


# --- keyed state ---


@query(
    "t3_task_status",
    """
WITH ev AS (
  SELECT user_id AS task_id, event_id AS id, epoch_us(ts) // 1000 AS ms,
         CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'stage' END AS type FROM events
),
ends AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ms, id) AS rn FROM ev),
first_end AS (SELECT task_id, min(CASE WHEN type IN ('done', 'error') THEN rn END) AS e,
                     min(CASE WHEN type = 'stage' THEN rn END) AS s, min(CASE WHEN type = 'submitted' THEN rn END) AS p FROM ends GROUP BY ALL)
SELECT n.task_id, n.id, n.ms, CASE WHEN n.rn = f.e THEN CASE n.type WHEN 'done' THEN 'succeeded' ELSE 'failed' END
         WHEN n.rn = f.s THEN 'running' ELSE 'pending' END AS status
FROM ends n JOIN first_end f USING (task_id)
WHERE n.rn = f.e OR (n.rn = f.s AND n.rn < coalesce(f.e, 1e9))
   OR (n.rn = f.p AND n.rn < coalesce(f.s, 1e9) AND n.rn < coalesce(f.e, 1e9))
""",
)
def _(t):
    kind = F.col("event_type")
    events = stream(t).events.select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("id"), _ms(),
        F.when(kind == "signup", "submitted").when(kind == "purchase", "done").when(kind == "error", "error")
        .otherwise("stage").alias("type"),
    )
    history = drain_updates(folds.task_history(events), "task-history", ["task_id"])
    return folds.status_changes(history).select("task_id", "id", "ms", "status")


_RATE_LIMIT = """
WITH RECURSIVE calls AS (
  SELECT user_id AS caller, event_id AS id, epoch_us(ts) // 1000 AS ms,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events
),
walk AS (
  SELECT caller, id, ms, rn, true AS accepted, [ms] AS log FROM calls WHERE rn = 1
  UNION ALL
  SELECT c.caller, c.id, c.ms, c.rn, len(list_filter(w.log, lambda x: x > c.ms - 86400000)) < 3,
         CASE WHEN len(list_filter(w.log, lambda x: x > c.ms - 86400000)) < 3
              THEN list_append(list_filter(w.log, lambda x: x > c.ms - 86400000), c.ms)
              ELSE list_filter(w.log, lambda x: x > c.ms - 86400000) END
  FROM walk w JOIN calls c ON c.caller = w.caller AND c.rn = w.rn + 1
)
SELECT caller, id, ms, accepted FROM walk
"""


def _calls(events):
    return events.select(F.col("user_id").alias("caller"), F.col("event_id").alias("id"), _ms())


@query("t6_rate_limit_log", _RATE_LIMIT)
def _(t):
    return sequences.rate_limit_log(_calls(t.events), ["caller"], limit=3, span=86_400_000)


@query("t6_rate_limit", _RATE_LIMIT)
def _(t):
    log = _calls(t.events)
    calls = state.rate_limit(_calls(stream(t).events), limit=3, span_ms=86_400_000, delay=covering(log))
    return in_time_order(
        drain(calls, "rate-limit"), log, ["caller"],
        lambda rows: sequences.rate_limit_log(rows, ["caller"], limit=3, span=86_400_000),
    )


_SEND_ONCE = """
WITH RECURSIVE tries AS (
  SELECT user_id % 60 AS candidate, event_id % 2 AS job, event_id AS id, epoch_us(ts) // 1000 AS ms, event_type <> 'error' AS ok,
         row_number() OVER (PARTITION BY user_id % 60, event_id % 2 ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events
),
walk AS (
  SELECT candidate, job, id, rn, CASE WHEN ok THEN 'sent' ELSE 'failed' END AS outcome, CASE WHEN ok THEN ms + 86400000 END AS held FROM tries WHERE rn = 1
  UNION ALL
  SELECT n.candidate, n.job, n.id, n.rn,
         CASE WHEN w.held IS NOT NULL AND n.ms < w.held THEN 'duplicate' WHEN n.ok THEN 'sent' ELSE 'failed' END,
         CASE WHEN w.held IS NOT NULL AND n.ms < w.held THEN w.held WHEN n.ok THEN n.ms + 86400000 END
  FROM walk w JOIN tries n ON n.candidate = w.candidate AND n.job = w.job AND n.rn = w.rn + 1
)
SELECT candidate, job, id, outcome FROM walk
"""


def _attempts(events):
    return events.select(
        (F.col("user_id") % 60).alias("candidate"), (F.col("event_id") % 2).alias("job"),
        F.col("event_id").alias("id"), _ms(), (F.col("event_type") != "error").alias("ok"),
    )


@query("t7_send_once_log", _SEND_ONCE)
def _(t):
    sent = sequences.send_once_log(_attempts(t.events), ["candidate", "job"])
    return sent.select("candidate", "job", "id", "outcome")


@query("t7_send_once", _SEND_ONCE)
def _(t):
    log, keys = _attempts(t.events), ["candidate", "job"]
    attempts = state.send_once(_attempts(stream(t).events), delay=covering(log))
    return in_time_order(
        drain(attempts, "send-once"), log, keys, lambda rows: sequences.send_once_log(rows, keys)
    )


@query(
    "t8_preference_stream",
    f"""
WITH {FEEDBACK},
marked AS (
  SELECT *, CASE WHEN seconds - lag(seconds) OVER (PARTITION BY user_id ORDER BY seconds, event_id) >= 43200 THEN 1 ELSE 0 END AS pause FROM fb
),
stretched AS (
  SELECT *, sum(pause) OVER (PARTITION BY user_id ORDER BY seconds, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM marked
),
sums AS (SELECT user_id, stretch, sum(step) AS s, max(seconds) AS last_feedback FROM stretched GROUP BY ALL)
SELECT user_id, last_feedback, greatest(-0.15, least(0.15, round(s, 6))) AS boost FROM sums
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY stretch DESC) = 1
""",
)
def _(t):
    log = StreamedTables(t.spark, t.sf_dir).views.feedback()
    slot_rows = feedback.preference_slots(log, ["user_id"], "seconds", 43_200)
    stored = drain_updates(slot_rows, "preference-slots", ["user_id", "_slot"])
    return feedback.boosts_from_slots(stored, ["user_id"], 43_200)


@query(
    "t5_task_checkpoints",
    """
WITH ev AS (
  SELECT user_id AS task_id, event_id AS id, epoch_us(ts) // 1000 AS ms, event_type AS type FROM events WHERE event_type IN ('view', 'purchase')
),
ends AS (
  SELECT task_id, coalesce(max(CASE WHEN type = 'purchase' THEN ms END), -1) AS done, max(CASE WHEN type = 'view' THEN ms END) AS last FROM ev GROUP BY ALL
)
SELECT ev.task_id, ev.ms, 'r' || id AS report FROM ev JOIN ends USING (task_id)
WHERE type = 'view' AND ms > done AND 1704067200000 + 30 * 86400000::BIGINT - last <= 86400000
""",
)
def _(t):
    names = F.when(F.col("event_type") == "view", "candidate_done").when(F.col("event_type") == "purchase", "done")
    events = stream(t).events.select(
        F.col("user_id").alias("task_id"), _ms(), F.coalesce(names, F.col("event_type")).alias("type"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("report"),
    )
    stored = drain(folds.checkpoint_rows(events), "checkpoint-rows")
    return incremental.checkpoint_reports(stored, F.lit(MONTH_END_MS), ttl_ms=86_400_000)


@query(
    "t9_session_memory",
    """
SELECT user_id AS session_id, 's' || arg_max(event_id, epoch_us(ts)) AS value, max(epoch_us(ts) // 1000) AS saved
FROM events GROUP BY ALL
HAVING 1704067200000 + 30 * 86400000::BIGINT - max(epoch_us(ts) // 1000) < 86400000
""",
)
def _(t):
    saves = stream(t).events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), _ms(),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("value"),
    )
    saved = drain_updates(folds.last_saved(saves), "sessions", ["session_id"])
    return folds.readable_sessions(saved, F.lit(MONTH_END_MS))


# --- event-time windows ---

_EDGES = "[" + ", ".join(str(e) for e in fixed.STAGE_EDGES) + "]"


@query(
    "t10_windowed_histograms",
    f"""
WITH obs AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, value FROM events),
cnt AS (
  SELECT w, event_type, list_transform({_EDGES}, lambda e: 0) AS z, list(value) AS vs, sum(value) AS s, count(*) AS n FROM obs GROUP BY ALL
)
SELECT epoch_us(w) // 1000000 AS window_start, '{{type="' || event_type || '"}}' AS labels,
       array_to_string(list_transform({_EDGES}, lambda e: len(list_filter(vs, lambda v: v <= e))), ',') AS cumulative, n AS count
FROM cnt WHERE epoch_us(w) + 3600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 600000000
""",
)
def _(t):
    rows = stream(t).events.select(
        F.lit("call_seconds").alias("name"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"),
        "value", _timestamp(),
    )
    hist = windows.windowed_histograms(rows, fixed.STAGE_EDGES, width="1 hour")
    return drain(hist, "windowed-histograms").select(
        F.unix_seconds("window_start").alias("window_start"), "labels",
        F.array_join(F.transform("cumulative", lambda c: c.cast("string")), ",").alias("cumulative"), "count",
    )


@query(
    "t7_first_sends",
    "SELECT user_id AS candidate, event_id % 2 AS job, 1::BIGINT AS sends FROM events WHERE event_type = 'purchase' GROUP BY ALL",
)
def _(t):
    # The whole table is one batch of the stream, so one row per key passes.
    sends = stream(t).events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("candidate"), (F.col("event_id") % 2).alias("job"), _timestamp()
    )
    rows = drain(windows.first_sends(sends, "40 days"), "first-sends")
    return rows.groupBy("candidate", "job").agg(F.count(F.lit(1)).alias("sends"))
