"""Batch functions for models. No model ships here: the caller passes a loader.

Each function loads its model once per Python worker and gets whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.session import send_by_value

send_by_value(__name__)

Encoder = Callable[[list[str]], list[list[float] | None]]
PairScorer = Callable[[list[str], list[str]], list[float]]


def embedder(load: Callable[[], Encoder]) -> Callable[[Column], Column]:
    """Text column -> vector column; a batch the model fails on gives NULL."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            try:
                yield pd.Series(encode(texts.fillna("").tolist()))
            except Exception:  # noqa: BLE001 a model failure must not fail the job
                yield pd.Series([None] * len(texts))

    return embed


def pair_scorer(load: Callable[[], PairScorer]) -> Callable[[Column, Column], Column]:
    """(query, document) columns -> score column; NULL where the model fails."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rate = load()
        for queries, documents in batches:
            try:
                yield pd.Series(rate(queries.tolist(), documents.tolist()), dtype="float64")
            except Exception:  # noqa: BLE001
                yield pd.Series([None] * len(queries), dtype="float64")

    return score


def ask_panel(pairs: DataFrame, load: Callable[[], Callable[[dict], str]], attempts: int = 2) -> DataFrame:
    """Add `raw` (a model answer) and `error` to (job, candidate, expert) rows; retries inside the task."""
    schema = T.StructType(
        [*pairs.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for batch in batches:
            answers = [_try(ask, row, attempts) for row in batch.to_dict("records")]
            yield batch.assign(raw=[a for a, _ in answers], error=[e for _, e in answers])

    return pairs.mapInPandas(run, schema)


def _try(ask: Callable[[dict], str], row: dict, attempts: int) -> tuple[str | None, str | None]:
    error = None
    for _ in range(attempts):
        try:
            return ask(row), None
        except Exception as exc:  # noqa: BLE001
            error = str(exc)[:200]
    return None, error
