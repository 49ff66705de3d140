"""Exact similarity of chosen pairs of texts, and Arrow helpers shared by the pair operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textvec as V

#: Up to so many rows of two longs each, a table of keys is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 200_000


#: Bytes of text and binary values in a slice, about; a longer text is a slice by itself.
SLICE_BYTES = 16 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches by rows and by bytes, so that flat arrays over their texts stay small; whole texts in any case."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto, i = np.cumsum(size), 0
        while i < b.num_rows:
            before = upto[i - 1] if i else 0
            j = min(i + rows, max(i + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right"))), b.num_rows)
            yield b.slice(i, j - i)
            i = j


def set_hash(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set of hashes, whatever their order."""
    total = np.concatenate([[V.U(0)], np.cumsum(V.mix(h ^ V.P2))])
    return V.mix((total[off[1:]] - total[off[:-1]]) ^ (np.diff(off).astype(V.U) * V.P1))


def keyed(df: DataFrame, keys: DataFrame, column: str, n_keys: int) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``keys``: broadcast by its counted size, else shuffled."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, column, "left_semi")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h, off = V.shingles(b.column(1).to_pylist())
        sets = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(V.signed(h)))
        yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["doc", "set"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs at or over ``threshold``.

    ``pairs`` has (a, b) longs and must be materialised; ``texts`` has (doc long, text), one row per doc.
    """
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = keyed(texts, ends, "doc", 2 * pairs.count())
    sets = wanted.mapInArrow(_sets, "doc long, set array<long>")
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sum"))
    j = F.col("common") / (F.col("sum") - F.col("common"))
    return both.where("common > 0").select("a", "b", j.alias("similarity")).where(F.col("similarity") >= threshold)
