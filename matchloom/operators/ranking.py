"""Keyed ranks, top-k, newest row per key and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGES = 1024
# Rows that one task may keep sorted for a page.
PAGE_SORT_ROWS = 100_000


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First k rows per key. Spark trims to k per key inside each partition before it shuffles."""
    return ranked(df, keys, order, name).where(F.col(name) <= k)


def score_ranks(df: DataFrame, keys: Sequence[str], score: str, name: str = "rank") -> DataFrame:
    """Competition rank per key, best score first; equal scores share a rank.

    Counts per distinct score first, so the running sum sees each score once and a key with very many rows
    is not sorted in one task.
    """
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    better = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(*keys, score, (F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1).alias(name))
    return df.join(ranks, [*keys, score])


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by `order`. An aggregate, so rows of a hot key combine map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, F.struct(*rest).alias("_rest")) if rest else F.struct(*order))
    picked = df.groupBy(*keys).agg(best.alias("_best"))
    columns = [
        F.col(c) if c in keys else F.col(f"_best.{c}") if c in order else F.col(f"_best._rest.{c}")
        for c in df.columns
    ]
    return picked.select(*columns)


def older_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that `newest_per_key` leaves out; `order` must tell rows of a key apart."""
    kept = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_newest"))
    return df.join(kept, list(keys)).where(F.struct(*order) != F.col("_newest")).drop("_newest")


def page_numbers(
    df: DataFrame, keys: Sequence[str], created_at: str, tie: str, size: int, bucket: Column | None = None
) -> DataFrame:
    """0-based page of each row per key, newest first, ties by `tie` ascending.

    Rows are numbered inside one time bucket and shifted by the count of all newer buckets, so a key
    with very many rows is numbered by many tasks.
    """
    bucketed = df.withColumn("_bucket", F.date_trunc("day", F.col(created_at)) if bucket is None else bucket)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    newer = (
        Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(created_at), F.asc(tie))
    return (
        bucketed.withColumn("_row", F.row_number().over(inside))
        .join(shift, [*keys, "_bucket"])
        .withColumn("page", F.floor((F.col("_shift") + F.col("_row") - 1) / F.lit(size)).cast("bigint"))
        .drop("_bucket", "_row", "_shift")
    )


def _as_number(df: DataFrame, name: str) -> Column | None:
    """The column as a whole number in the same order, or None where its type has no such number."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        return col.cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)
    return None


def _narrow(rows: DataFrame, number: Column, rank: int, newest_first: bool, max_rows: int) -> tuple[DataFrame, int, int]:
    """(rows around the one at `rank`, their number, rows before them): at most `max_rows`, or all of one value.

    Each step counts the rows in about `_RANGES` ranges of equal width and goes on in the one that holds the rank, so the
    driver gets no more than that many counts. NULL sorts below every number.
    """
    low, high, n = rows.agg(F.min(number), F.max(number), F.count(F.lit(1))).first()
    if rank >= n:
        return rows.limit(0), 0, 0
    if n <= max_rows or low is None:
        return rows, n, 0
    key, low, before = F.coalesce(number, F.lit(low - 1)), low - 1, 0
    while n > max_rows and low < high:
        width = -(-(high - low + 1) // _RANGES)
        by_range = (key - F.pmod(key, F.lit(width))).alias("start")
        counts = rows.where(key.between(low, high)).groupBy(by_range).agg(F.count(F.lit(1)).alias("n")).collect()
        for start, n in sorted(counts, reverse=newest_first):
            if before + n > rank:
                break
            before += n
        low, high = max(low, start), min(high, start + width - 1)
    return rows.where(key.between(low, high)), n, before


def _beside(col: Column, value, above: bool) -> Column:
    """Whether the column is above or below a value, with NULL as the least value of all."""
    if value is None:
        return col.isNotNull() if above else F.lit(False)
    return F.coalesce(col > F.lit(value), F.lit(False)) if above else F.coalesce(col < F.lit(value), F.lit(True))


def page(
    df: DataFrame, created_at: str, tie: str, offset: int = 0, limit: int = 200, max_rows: int = PAGE_SORT_ROWS
) -> DataFrame:
    """One page of rows, newest first. `limit` <= 0 means the default page.

    Up to `max_rows` rows each task keeps its first offset + limit. A deeper page first looks for the row at the offset by
    counts of key ranges, then keeps `limit` rows from there on: nothing sorts or gathers the rows before it. Rows equal
    in both columns may change places. A `tie` that is neither whole number nor time is sorted within one instant.
    """
    size = limit if limit > 0 else 200
    order = [F.desc(created_at), F.asc(tie)]
    time = _as_number(df, created_at)
    if offset + size <= max_rows or time is None:
        return df.orderBy(*order).offset(offset).limit(size)
    near, n, before = _narrow(df, time, offset, True, max_rows)
    by_id = _as_number(df, tie)
    if n > max_rows and by_id is not None:
        near, n, skipped = _narrow(near, by_id, offset - before, False, max_rows)
        before += skipped
    ident = F.col(tie) if by_id is None else by_id
    first = near.orderBy(*order).offset(offset - before).limit(1).select(time, ident).first()
    if first is None:
        return df.limit(0)
    newer, same_time = _beside(time, first[0], above=True), time.eqNullSafe(F.lit(first[0]))
    before += near.where(newer | (same_time & _beside(ident, first[1], above=False))).count()
    rest = df.where(~newer & ~(same_time & _beside(ident, first[1], above=False)))
    return rest.orderBy(*order).offset(offset - before).limit(size)


def load_for_screening(df: DataFrame, created_at: str, tie: str, limit: int, page_size: int = 200) -> DataFrame:
    """Up to `limit` rows, newest first; `limit` <= 0 gives one page."""
    return df.orderBy(F.desc(created_at), F.asc(tie)).limit(limit if limit > 0 else page_size)


def ranked_candidates(ranking: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of a ranking with the ranking's columns; entries without a candidate drop out."""
    return ranking.join(candidates, keys)
