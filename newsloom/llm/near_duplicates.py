"""Near-duplicate records by a multi-index Hamming join on b-bit MinHash signatures.

Each text becomes a signature of CHUNKS x CHUNK symbols of 16 bits (minima of as many hash functions over
its five-word shingles). The signature is split into chunks; within a chunk up to ERRORS symbols may
differ, and every way to leave ERRORS symbols out is enumerated as a join key. By the pigeonhole
principle all pairs whose signatures differ in at most CHUNKS * (ERRORS + 1) - 1 = 63 of the 160 symbols
share a key. For a similarity of 0.8 (32 symbols differ, standard deviation 5) that is six deviations;
at 0.5 (80 differ) a pair shares a key with probability 0.9987, at 0.55 with 0.99992. Candidates whose
signatures differ too much for the threshold (4.5 standard deviations) go, the others are checked on
their whole shingle sets.

Texts with the same shingle set form one class, found by a hash of the set; only one text per class
takes part in the join, so that a group of exact copies of any size costs no more than one text.

Cases: null or blank text, and texts under five words, have no shingles and pair with nothing; the same
id delivered again is no pair; an id with several texts pairs by any of them; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textvec as V
from newsloom.llm.similarity import BROADCAST_ROWS, set_hash, slices, verified
from newsloom.operators.dedup import bucket_pairs
from newsloom.operators.graphs import connected_components
from newsloom.session import checkpointed

CHUNKS, CHUNK, ERRORS = 32, 5, 1
SYMBOLS = CHUNKS * CHUNK
_SEEDS = V.mix(np.arange(1, SYMBOLS + 1, dtype=V.U) * V.P1)
_FACTOR = (_SEEDS >> V.U(32)).astype(np.uint32) | np.uint32(1)
_ADD = _SEEDS.astype(np.uint32)


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, SYMBOLS) of 16-bit symbols; zeros where a text has no shingles."""
    out = np.zeros((len(off) - 1, SYMBOLS), np.uint16)
    some = np.flatnonzero(np.diff(off))
    if not len(some):
        return out
    at = off[some]
    halves = h.astype(np.uint32), (h >> V.U(32)).astype(np.uint32)
    for i in range(SYMBOLS):
        x = halves[i % 2] * _FACTOR[i] + _ADD[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(x, at)
        out[some, i] = (least * np.uint32(0x297A2D39)) >> np.uint32(16)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        h, off = V.shingles(b.column(1).to_pylist())
        n = np.diff(off)
        sig = signatures(h, off)
        keep = pa.array(n > 0)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0).filter(keep),
                pa.array(V.signed(set_hash(h, off))).filter(keep),
                pa.array([s.tobytes() for s in sig], pa.binary()).filter(keep),
            ],
            names=["id", "doc", "sig"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = list(combinations(range(CHUNK), CHUNK - ERRORS))
    for b in slices(batches, 2000):
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(V.U)
        doc = b.column(0).to_numpy()
        salt = np.arange(CHUNKS, dtype=V.U)
        for j, cols in enumerate(kept):
            x = np.zeros(sig.shape[:2], V.U)
            for c in cols:
                x = (x << V.U(16)) | sig[:, :, c]
            x = V.mix(x + (salt * V.U(len(kept)) + V.U(j)) * V.P2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(V.signed(x.ravel())), pa.array(np.repeat(doc, CHUNKS))], names=["key", "doc"]
            )


def _close(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array((x != y).sum(1) <= limit))

    return run


def describe(df: DataFrame, id: str, text) -> DataFrame:
    """(id, doc, sig): doc is the hash of the shingle set, equal for texts that are equal by their shingles."""
    rows = df.select(F.col(id).cast("string").alias("id"), text.alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(_describe, "id string, doc long, sig binary")


def class_pairs(described: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) between representatives of different classes. ``texts``: (id, text)."""
    classes = described.groupBy("doc").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    keys = classes.select("doc", "sig").mapInArrow(_keys, "key long, doc long")
    found = bucket_pairs(keys)
    sigs = classes.select("doc", "sig")
    both = found.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a")
    both = both.join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    limit = int(SYMBOLS * (1 - threshold) + 4.5 * np.sqrt(SYMBOLS * threshold * (1 - threshold)) + 1)
    near = checkpointed(both.mapInArrow(_close(limit), "a long, b long"))
    ends = near.select(F.col("a").alias("doc")).union(near.select(F.col("b").alias("doc"))).distinct()
    chosen = classes.join(ends, "doc", "left_semi").select("doc", "id")
    n = 2 * near.count()
    return verified(near, _texts_of(texts, chosen, n), threshold)


def _texts_of(texts: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    chosen = F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen
    return texts.join(chosen, "id").groupBy("doc").agg(F.first("text").alias("text"))


def near_duplicate_pairs(df: DataFrame, id: str, text, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids whose texts have at least this similarity, copies expanded."""
    described = checkpointed(describe(df, id, text))
    members = described.select("id", "doc").distinct()
    texts = df.select(F.col(id).cast("string").alias("id"), text.alias("text"))
    pairs = class_pairs(described, texts, threshold).select("a", "b")
    left = members.select(F.col("doc").alias("a"), F.col("id").alias("ia"))
    right = members.select(F.col("doc").alias("b"), F.col("id").alias("ib"))
    across = pairs.join(left, "a").join(right, "b").where("ia <> ib")
    within = left.join(right, F.col("a") == F.col("b")).where("ia < ib")
    out = across.select("ia", "ib").union(within.select("ia", "ib"))
    return out.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, id: str, text, threshold: float = 0.8) -> DataFrame:
    """(id, doc, group_id, n_links): one row per record with its class, its group and the number of links
    its class has to other texts. Records that resemble no other form their own group."""
    described = checkpointed(describe(df, id, text))
    texts = df.select(F.col(id).cast("string").alias("id"), text.alias("text"))
    pairs = checkpointed(class_pairs(described, texts, threshold).select("a", "b"))
    groups = connected_components(pairs)
    both = pairs.union(pairs.select("b", "a")).groupBy(F.col("a").alias("doc")).agg(F.count("*").alias("n_links"))
    members = described.select("id", "doc").distinct()
    out = members.join(groups.withColumnRenamed("node", "doc"), "doc", "left").join(both, "doc", "left")
    return out.select("id", "doc", F.coalesce("component", "doc").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
