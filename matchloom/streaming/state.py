"""Keyed state for rules that depend on the order of events: rate limit, send once, idle tasks.

Everything else about the event log is an aggregate (see `folds`). Times are event times in milliseconds.
Rows of one key and batch are ordered by time first, so give the source a trigger limit (files, bytes or
offsets per trigger): it bounds a batch, and the rules below bound the state. State that a rule no longer needs goes:
timers on the watermark clear keys without recent calls, and ended and idle tasks. Keys and ids have any type.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchloom.session import send_by_value
from matchloom.streaming.runner import use_rocksdb

send_by_value(__name__)

_HOUR = 3_600_000


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class _Keyed(StatefulProcessor):
    """One value of state per key; subclasses give `schema` and `step`."""

    state_schema = "v bigint"
    order = ["ms"]
    keep_ms = 0  # after a key's last event, when its state says nothing any more

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        out, newest = [], 0
        # newest time of earlier batches
        before = self.timer.get()[0] - self.keep_ms if self.timer.exists() else None
        for row in _in_order(rows, self.order).to_dict("records"):
            newest = row["ms"]
            state, produced = self.step(state, row)
            if produced is not None:
                out.append((*key, *produced, before is not None and row["ms"] <= before))
        planned = self.timer.get()[0] if self.timer.exists() else None
        if planned is not None:
            self.handle.deleteTimer(planned)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        # The newest time outlives the state: it tells which later rows come out of order.
        end = max(int(newest) + self.keep_ms, planned or 0)
        self.timer.update((end,))
        self.handle.registerTimer(end)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.timer.clear()
        yield from ()

    def close(self) -> None:
        pass


def _typed(events: DataFrame, *names: str) -> str:
    """Columns of the events in the form of a schema text."""
    return ", ".join(f"{n} {events.schema[n].dataType.simpleString()}" for n in names)


def _run(events: DataFrame, keys: list[str], processor: _Keyed, schema: str, keep_ms: int, delay: str) -> DataFrame:
    """State goes when the watermark passes `keep_ms` after a key's last event; events that come later than `delay`
    behind the newest one are left out."""
    use_rocksdb(events.sparkSession)
    processor.columns = [part.split()[0] for part in schema.split(",")]
    processor.keep_ms = keep_ms
    timed = events.withColumn("_time", F.timestamp_millis("ms")).withWatermark("_time", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


class _RateLimit(_Keyed):
    """Sliding log of accepted calls: at most `limit` per span; refused calls leave no trace."""

    state_schema = "log array<bigint>"

    def __init__(self, limit: int, span_ms: int, order: list[str]):
        self.limit, self.span, self.order = limit, span_ms, order

    def step(self, state, row):
        log = state[0] if state else []  # at most `limit` times, in order
        gone = bisect_right(log, row["ms"] - self.span)
        log = log[gone:] if gone else log
        accepted = len(log) < self.limit
        if accepted:
            log.append(row["ms"])
        return (log,), (row["id"], row["ms"], accepted)


def rate_limit(calls: DataFrame, limit: int, span_ms: int = 60_000, *, delay: str) -> DataFrame:
    """(caller, id, ms, accepted, late) per call; `calls`: caller, id, ms. A log is kept for the span.

    Calls that come later than `delay` behind the newest one get no row, so it has no default. `late`: an earlier batch had a call of the
    caller that is not older, so answers are in order of arrival, not of time.
    """
    schema = f"{_typed(calls, 'caller', 'id')}, ms bigint, accepted boolean, late boolean"
    return _run(calls, ["caller"], _RateLimit(limit, span_ms, ["ms", "id"]), schema, span_ms, delay)


class _SendOnce(_Keyed):
    """A successful send blocks repeats for a day; a failed one frees the key at once."""

    def __init__(self, hold_ms: int, order: list[str]):
        self.hold, self.order = hold_ms, order

    def step(self, state, row):
        held = state is not None and row["ms"] < state[0]
        if held:
            return state, (row["id"], "duplicate")
        if row["ok"]:
            return (row["ms"] + self.hold,), (row["id"], "sent")
        return None, (row["id"], "failed")


def send_once(attempts: DataFrame, hold_ms: int = 24 * _HOUR, *, delay: str) -> DataFrame:
    """(candidate, job, id, outcome, late) per attempt; `attempts`: candidate, job, id, ms, ok. A key is kept for the
    hold. `delay` and `late` are those of `rate_limit`."""
    schema = f"{_typed(attempts, 'candidate', 'job', 'id')}, outcome string, late boolean"
    rule = _SendOnce(hold_ms, ["ms", "id"])
    return _run(attempts, ["candidate", "job"], rule, schema, hold_ms, delay)


class _Idle(StatefulProcessor):
    """A timer per task; it fires when the watermark passes the idle time after the last event.

    It reports an open task and forgets an ended one; until then later events do not reopen it.
    """

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, timer bigint, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, timer, ended = self.last.get() if self.last.exists() else (0, None, False)
        if timer is not None:
            self.handle.deleteTimer(timer)
        for batch in rows:
            newest = int(max(newest, batch["ms"].max()))
            ended = bool(ended or batch["type"].isin(["done", "error"]).any())
        self.handle.registerTimer(newest + self.idle)
        self.last.update((newest, newest + self.idle, ended))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, ended = self.last.get()
        self.last.clear()
        if not ended:
            yield pd.DataFrame({"task_id": [key[0]], "last_event": [last]})

    def close(self) -> None:
        pass


def idle_alerts(events: DataFrame, idle_ms: int = 15_000, delay: str = "10 seconds") -> DataFrame:
    """(task_id, last_event) of open tasks without events for the idle time; `events`: task_id, ts, type."""
    use_rocksdb(events.sparkSession)
    timed = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=_Idle(idle_ms),
        outputStructType=f"{_typed(events, 'task_id')}, last_event bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
