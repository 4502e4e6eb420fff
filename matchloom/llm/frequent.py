"""The most frequent rows of a table of counts, as many as fit a bound, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEVELS = sorted({round(1.25**j) for j in range(160)})  # up to 10**15


def least_count(counts: DataFrame, n: str, max_rows: int, at_least: int = 1) -> int:
    """The lowest of fixed levels that at most `max_rows` rows reach: one aggregate row, whatever the table's size."""
    levels = [level for level in _LEVELS if level >= at_least]
    found = counts.agg(*[F.count_if(F.col(n) >= level).alias(f"l{i}") for i, level in enumerate(levels)]).first()
    return next((level for i, level in enumerate(levels) if found[i] <= max_rows), levels[-1] + 1)


def frequent(counts: DataFrame, n: str, max_rows: int, at_least: int = 1) -> DataFrame:
    """Rows of a stored table that reach that level; rows of equal count stay or go together."""
    return counts.where(F.col(n) >= least_count(counts, n, max_rows, at_least))
