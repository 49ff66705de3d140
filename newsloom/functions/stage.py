"""Columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and ``columns``, each evaluated once per row.

    A one-row generator carries the columns. The optimizer pushes filters through projections by copying
    expressions into them, which grows without bound where stages build on each other; it does not copy
    out of a generator, and the generator stays inside whole-stage code.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(*columns)
    return df.select(*[df[f"`{k}`"] for k in keep], made)
