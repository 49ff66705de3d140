"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null vector or one of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def rrf(rank: Column, k: int = 60, weight: float = 1.0) -> Column:
    """Reciprocal-rank score of a 1-based rank; absent ranks give 0."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its length, in double; null for one of length 0."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(F.arrays_zip(a.alias("a"), F.array_repeat(n, F.size(a)).alias("n")), lambda p: p["a"].cast("double") / p["n"])
