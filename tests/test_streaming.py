"""Streams over several batches give what the batch form gives."""

import random
import time

import pytest
from pyspark.sql import functions as F

from matchloom.operators import feedback as B
from matchloom.operators.incremental import checkpoint_reports
from matchloom.operators.sequences import rate_limit_log, send_once_log
from matchloom.sources.events import event_lines, parse_event_lines, read_task, write_by_task
from matchloom.streaming import folds, state, windows
from matchloom.streaming.runner import append_to, drain, drain_updates
from workload import streams
from workload.registry import QUERIES


def as_stream(spark, df, path, order, parts=4):
    """The rows as several files read one per batch, in the given order."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        piece = rows[i * size : (i + 1) * size]
        if piece:
            spark.createDataFrame(piece, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def calls(spark, n=150, seed=4):
    rng = random.Random(seed)
    rows = sorted((rng.choice([1, 1, 1, 2]), rng.randrange(4000)) for _ in range(n))
    return spark.createDataFrame([(c, i, ms) for i, (c, ms) in enumerate(rows)], "caller long, id long, ms long")


def brute_limit(rows, limit, span):
    logs, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["ms"], r["id"])):
        log = [t for t in logs.get(r["caller"], []) if t > r["ms"] - span]
        out[r["id"]] = len(log) < limit
        if out[r["id"]]:
            log.append(r["ms"])
        logs[r["caller"]] = log
    return out


@pytest.mark.parametrize("span", [7, 60, 400])
def test_rate_limit_log_equals_brute_force(spark, span):
    df = calls(spark)
    got = {r["id"]: r["accepted"] for r in rate_limit_log(df, ["caller"], 3, span).collect()}
    assert got == brute_limit(df.collect(), 3, span)


def test_rate_limit_stream(spark, tmp_path):
    df = calls(spark)
    stream = as_stream(spark, df, str(tmp_path / "in"), "ms", 3)
    got = {r["id"]: r["accepted"] for r in drain(state.rate_limit(stream, 3, 200, delay="1 hour"), "limit").collect()}
    assert got == brute_limit(df.collect(), 3, 200)


def brute_sends(rows, hold):
    held, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["ms"], r["id"])):
        key = (r["candidate"], r["job"])
        if key in held and r["ms"] < held[key]:
            out[r["id"]] = "duplicate"
            continue
        held.pop(key, None)
        out[r["id"]] = "sent" if r["ok"] else "failed"
        if r["ok"]:
            held[key] = r["ms"] + hold
    return out


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_rows_out_of_time_order_are_told_and_settled(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([1, 2]), 7, i, rng.randrange(900), rng.random() < 0.6) for i in range(60)]
    rows += [(3, 7, 101, 10, False), (3, 7, 100, 5, True)]  # a failed attempt, and one before it that comes later
    df = spark.createDataFrame(rows, "candidate long, job long, id long, ms long, ok boolean")
    stream = as_stream(spark, df.withColumn("_at", F.hash("id")), str(tmp_path / "sends"), F.desc("id") if parts == 5 else "_at", parts)
    answers = drain(state.send_once(stream.drop("_at"), 150, delay="2 seconds"), "late-sends")
    settled = streams.in_time_order(answers, df, ["candidate", "job"], lambda x: send_once_log(x, ["candidate", "job"], 150))
    assert {r["id"]: r["outcome"] for r in settled.collect()} == brute_sends(df.collect(), 150)

    one = spark.createDataFrame([(3, 7, 2, 10, False)], df.schema), spark.createDataFrame([(3, 7, 1, 5, True)], df.schema)
    for i, part in enumerate(one):
        part.coalesce(1).write.parquet(str(tmp_path / "two" / f"{i:03d}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "two" / "*"))
    late = {r["id"]: r["late"] for r in drain(state.send_once(stream, 150, delay="1 hour"), "two-sends").collect()}
    assert late == {2: False, 1: True}


def test_state_ends_behind_the_watermark(spark, tmp_path):
    rows = [(1 if i < 3 else 2, i, ms) for i, ms in enumerate([1_000_000, 1_000_010, 1_000_020, 1_100_000, 1_200_000, 1_200_001])]
    df = spark.createDataFrame(rows, "caller long, id long, ms long")
    stream = as_stream(spark, df, str(tmp_path / "calls"), "ms", 6)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query = append_to(state.rate_limit(stream, 2, 50, delay="1 second"), path, checkpoint)
    query.awaitTermination()
    # A batch of one row replaces one timer; a second one that goes is that of a key whose time is over.
    gone = max(op["customMetrics"]["numDeletedTimers"] for p in query.recentProgress for op in p["stateOperators"])
    got = {r["id"]: r["accepted"] for r in spark.read.parquet(path).collect()}
    assert got == brute_limit(df.collect(), 2, 50) and gone == 2


@pytest.mark.parametrize("name", ["t6_rate_limit", "t7_send_once"])
def test_files_out_of_time_order(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(streams, "BATCH_BYTES", 1)  # one file per batch
    rows = spark.range(300).selectExpr(
        "id AS event_id", "id % 4 AS user_id", "timestamp_seconds(1704067200 + id * 3600) AS ts",
        "if(id % 5 = 0, 'error', 'view') AS event_type",
    )
    for part in (2, 0, 1):  # a day and more apart, the newest first
        piece = rows.where(f"event_id div 100 = {part}").coalesce(1)
        piece.write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)
    got = QUERIES[name](spark, str(tmp_path))
    want = QUERIES[f"{name}_log"](spark, str(tmp_path)).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 300


def test_send_once(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(2), rng.randrange(2), i, rng.randrange(3000), rng.random() < 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "candidate long, job long, id long, ms long, ok boolean")
    want = brute_sends(df.collect(), 150)
    log = send_once_log(df, ["candidate", "job"], 150)
    assert {r["id"]: r["outcome"] for r in log.collect()} == want
    stream = as_stream(spark, df, str(tmp_path / "in"), "ms", 3)
    assert {r["id"]: r["outcome"] for r in drain(state.send_once(stream, 150, delay="1 hour"), "sends").collect()} == want


def test_status_does_not_depend_on_arrival(spark, tmp_path):
    rows = [
        (1, 1, 10, "submitted"), (1, 2, 20, "stage"), (1, 3, 30, "cost"), (1, 4, 40, "done"), (1, 5, 50, "error"),
        (2, 6, 10, "stage"), (2, 7, 15, "submitted"), (2, 8, 60, "error"),
        (3, 9, 5, "submitted"),
    ]
    df = spark.createDataFrame(rows, "task_id long, id long, ms long, type string")
    want = {(1, "pending", 10), (1, "running", 20), (1, "succeeded", 40), (2, "running", 10), (2, "failed", 60), (3, "pending", 5)}
    batch = folds.status_changes(folds.task_history(df)).collect()
    assert {(r["task_id"], r["status"], r["ms"]) for r in batch} == want
    # Newest first: every file brings earlier events.
    stream = as_stream(spark, df, str(tmp_path / "in"), F.desc("ms"), 5)
    history = drain_updates(folds.task_history(stream), "history", ["task_id"])
    assert {(r["task_id"], r["status"], r["ms"]) for r in folds.status_changes(history).collect()} == want


def test_preference_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(5), rng.choice(["suitable", "not_suitable", "pending"]), rng.randrange(2000)) for _ in range(90)]
    df = spark.createDataFrame(rows, "user_id long, feedback string, ts long")
    want = {tuple(r) for r in B.expiring_boosts(df, ["user_id"], "ts", 40).collect()}
    stream = as_stream(spark, df, str(tmp_path / "in"), "ts")
    stored = drain_updates(B.preference_slots(stream, ["user_id"], "ts", 40), "slots", ["user_id", "_slot"])
    assert {tuple(r) for r in B.boosts_from_slots(stored, ["user_id"], 40).collect()} == want


def test_checkpoints_end_and_expire(spark):
    rows = [
        (1, 10, "candidate_done", "a"), (1, 20, "done", None), (1, 30, "candidate_done", "b"),
        (2, 10, "candidate_done", "c"), (3, 900, "candidate_done", "d"), (3, 950, "done", None),
    ]
    df = spark.createDataFrame(rows, "task_id long, ms long, type string, report string")
    got = {(r["task_id"], r["report"]) for r in checkpoint_reports(df, F.lit(100), 75).collect()}
    assert got == {(1, "b")}


EVENT_LINES = [
    ("t1", 1, '{"type": "stage", "progress": 5, "message": "go"}'),
    ("t1", 2, '{"type": "agent_result", "candidate_id": "c1", "result": {"score": 3}}'),
    ("t1", 3, "not json"),
    ("t1", 4, '{"progress": 5}'),
    ("t1", 5, '{"type": "divergence", "candidate_id": "c1", "mean": 70.5, "std": 3.0}'),
    ("t1", 6, '{"type": "candidate_done", "candidate_id": "c1", "cached": true, "report": {"overall_score": 71.5}}'),
    ("t1", 7, '{"type": "cost", "usage": {"model_name": "m", "tokens_prompt": 10, "tokens_completion": 2, "cost": 0.5}}'),
    ("t1", 8, '{"type": "done", "results": [1, 2]}'),
    ("t1", 9, '{"type": "stage"}'),
    ("t2", 1, '{"type": "candidate_failed", "candidate_id": "c9", "message": "broken"}{'),
    ("t2", 2, '{"type": "candidate_failed", "candidate_id": "c9", "message": "broken"}'),
]


def log(spark):
    return spark.createDataFrame(EVENT_LINES, "task_id string, occurred_at long, value string")


def test_event_lines(spark, tmp_path):
    events = parse_event_lines(log(spark))
    assert sorted((r["task_id"], r["occurred_at"]) for r in events.select("task_id", "occurred_at").collect()) == [
        ("t1", 1), ("t1", 2), ("t1", 5), ("t1", 6), ("t1", 7), ("t1", 8), ("t1", 9), ("t2", 2)
    ]
    cost = folds.cost_rows(events).first()
    assert (cost["trace_id"], cost["tokens_prompt"], cost["tokens_completion"], cost["cost"]) == ("t1", 10, 2, 0.5)
    flat = events.select("task_id", "occurred_at", "type")
    write_by_task(flat, str(tmp_path / "sink"), buckets=4)
    mine = read_task(spark, str(tmp_path / "sink"), "t1", buckets=4)
    assert {r["occurred_at"] for r in mine.collect()} == {1, 2, 5, 6, 7, 8}
    assert '"type":"stage"' in event_lines(flat).where("value like '%stage%'").first()["value"]


def test_live_view_and_outcome_stream(spark, tmp_path):
    stream = parse_event_lines(as_stream(spark, log(spark), str(tmp_path / "in"), "occurred_at"))
    view = drain_updates(folds.live_view(stream), "view", ["task_id", "candidate_id"])
    rows = {(r["task_id"], r["candidate_id"]): r for r in view.collect()}
    first = rows[("t1", "c1")]
    assert (first["results"], first["mean"], first["std"], first["overall_score"]) == (1, 70.5, 3.0, 71.5)
    assert rows[("t2", "c9")]["failed"] == "broken"
    outcome = drain_updates(folds.task_outcome(stream), "outcome", ["task_id"])
    got = {r["task_id"]: (r["status"], r["results"], r["cached"]) for r in outcome.collect()}
    assert got == {"t1": ("completed", 2, 1), "t2": ("failed", 0, 0)}


def test_idle_alerts(spark, tmp_path):
    rows = [(f"task-{t}", s, kind) for t, s, kind in [(1, 0, "stage"), (1, 5, "stage"), (2, 0, "stage"), (2, 8, "done"), (3, 300, "stage"), (3, 400, "stage"), (3, 500, "stage")]]
    df = spark.createDataFrame(rows, "task_id string, s long, type string").select("task_id", F.timestamp_seconds("s").alias("ts"), "type")
    stream = as_stream(spark, df, str(tmp_path / "in"), "ts")
    alerts = drain(state.idle_alerts(stream, 15_000, "1 second"), "idle")
    got = {(r["task_id"], r["last_event"]) for r in alerts.collect()}
    assert ("task-1", 5000) in got and not any(t == "task-2" for t, _ in got)
    idle = folds.idle_tasks(
        df.select("task_id", F.unix_millis("ts").alias("occurred_at"), "type"), F.lit(510_000)
    )
    assert {r["task_id"] for r in idle.collect()} == {"task-1"}


def test_windowed_histograms_stream(spark, tmp_path):
    rows = [("h", {"a": "b"}, float(i % 5), i * 20) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, value double, s long")
    df = df.select("name", "labels", "value", F.timestamp_seconds("s").alias("ts"))
    stream = as_stream(spark, df, str(tmp_path / "in"), "ts")
    hist = drain(windows.windowed_histograms(stream, [0.0, 2.0], "1 minute", "10 seconds"), "hist").collect()
    # 60 events, three a minute; windows that end before the last event minus the delay are out.
    assert len(hist) == 19 and all(r["count"] == 3 for r in hist)
    assert sum(r["cumulative"][0] for r in hist) == sum(1 for i in range(57) if i % 5 == 0)
