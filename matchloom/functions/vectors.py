"""Vector functions over float arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    length = F.sqrt(dot(a, a))
    return F.when(length == 0, F.lit(1e-9)).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine mapped to 0..1."""
    return F.round((cosine(a, b) + 1.0) / 2.0, 6)
