"""Rules that depend on the order of a key's events: rate limit and send-once over stored logs.

A key's history falls apart wherever it pauses long enough to forget everything; the pieces run in
parallel. Each piece is scanned in time order with constant memory, never collected.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.session import send_by_value

send_by_value(__name__)


def slots(df: DataFrame, keys: list[str], ts: str, pause: int, *aggregates) -> DataFrame:
    """(keys, _slot, _first, _last, ...): events summed per slot no longer than the pause, map-side."""
    slot = F.floor(F.col(ts) / F.lit(pause)).alias("_slot")
    return df.groupBy(*keys, slot).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), *aggregates)


def stretches(slot_rows: DataFrame, keys: list[str], pause: int) -> DataFrame:
    """Number the unbroken stretches of each key. Events of one slot are never apart by a pause."""
    in_order = Window.partitionBy(*keys).orderBy("_slot")
    paused = F.col("_first") - F.lag("_last").over(in_order) >= pause
    return slot_rows.withColumn("_stretch", F.sum(F.when(paused, 1).otherwise(0)).over(in_order))


def with_stretch(df: DataFrame, keys: list[str], ts: str, pause: int) -> DataFrame:
    """Add `_stretch`, which grows at every pause of the key."""
    numbered = stretches(slots(df, keys, ts, pause), keys, pause).select(*keys, "_slot", "_stretch")
    slotted = df.withColumn("_slot", F.floor(F.col(ts) / F.lit(pause)))
    return slotted.join(numbered, [*keys, "_slot"]).drop("_slot")


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    new_state: Callable[[], object],
    step: Callable[[object, dict], object],
    name: str,
    dtype: T.DataType,
) -> DataFrame:
    """Add a column computed by `step(state, row)` over each key's rows in order.

    Rows are sorted by Spark (spilling as needed) and pass through in Arrow batches; only the state of the
    current key is held.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, dtype)])
    arrow = {
        T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.LongType: pa.int64(), T.DoubleType: pa.float64()
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = batch.to_pylist()
            values = []
            for row in rows:
                row_key = tuple(row[k] for k in keys)
                if row_key != key:
                    key, state = row_key, new_state()
                values.append(step(state, row))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, arrow[type(dtype)])], names=[*batch.schema.names, name]
            )

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, schema)


def rate_limit_log(calls: DataFrame, keys: list[str], limit: int, span: int = 60_000) -> DataFrame:
    """Add `accepted` to calls (keys, id, ms): at most `limit` accepted per span; refused ones do not count."""

    def step(log: deque, row: dict) -> bool:
        while log and log[0] <= row["ms"] - span:
            log.popleft()
        accepted = len(log) < limit
        if accepted:
            log.append(row["ms"])
        return accepted

    pieces = with_stretch(calls, keys, "ms", span)
    scanned = ordered_scan(pieces, [*keys, "_stretch"], ["ms", "id"], deque, step, "accepted", T.BooleanType())
    return scanned.drop("_stretch")


def send_once_log(attempts: DataFrame, keys: list[str], hold: int = 86_400_000) -> DataFrame:
    """Add `outcome` to attempts (keys, id, ms, ok): sent, duplicate (within the hold of a sent one) or failed."""

    def step(state: list, row: dict) -> str:
        if state and row["ms"] < state[0]:
            return "duplicate"
        state.clear()
        if not row["ok"]:
            return "failed"
        state.append(row["ms"] + hold)
        return "sent"

    pieces = with_stretch(attempts, keys, "ms", hold)
    scanned = ordered_scan(pieces, [*keys, "_stretch"], ["ms", "id"], list, step, "outcome", T.StringType())
    return scanned.drop("_stretch")
