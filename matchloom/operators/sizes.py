"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a few short columns: well below 100 MB on each executor.
MAX_BROADCAST_ROWS = 500_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether a table has at most `max_rows` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a table that was counted to be small; else leave the join to the optimizer.

    Meant for the job side of a join, which is cheap to count.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks among which rows are dealt so that each gets about `rows_per_task` at most; the usual number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def has_repeats(df: DataFrame, keys: list[str]) -> bool:
    """Whether some key has several rows; nulls are equal here."""
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def many_tasks(df: DataFrame, rows_per_task: int) -> int | None:
    """Tasks of about `rows_per_task` rows for a table that is stored or cheap to count; None for few rows a core."""
    spark, rows = df.sparkSession, df.count()
    few = rows <= rows_per_task * spark.sparkContext.defaultParallelism
    return None if few else tasks_for(spark, rows, rows_per_task)


def dealt(df: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """The rows of a stored table dealt by key to tasks of about `rows_per_task`; few rows a core stay as they are.

    A split or a coalesced partition has bounded bytes, but well compressed rows of that many bytes may be too many for the
    aggregates of one task. Later joins and aggregates by the keys need no further shuffle.
    """
    tasks = many_tasks(df, rows_per_task)
    return df if tasks is None else df.repartition(tasks, *keys)


def only_keys_of(big: DataFrame, small: DataFrame, keys: list[str], max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows of a large table whose keys occur in a small one, found without shuffling the large table.

    `small` should be stored or cheap, as it is counted.
    """
    wanted = small.select(*keys).distinct()
    return big.join(broadcast_if_small(wanted, max_rows), keys, "left_semi")


def only_owners_of(
    big: DataFrame, small: DataFrame, keys: list[str], max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """As `only_keys_of`, for pieces cut from larger rows: as a condition it goes below the cutting, which is then done for
    the rows of the wanted owners only. A join stays above an explode.
    """
    wanted = broadcast_if_small(small.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct(), max_rows)
    return big.where((F.struct(*keys) if len(keys) > 1 else F.col(keys[0])).isin(wanted))
