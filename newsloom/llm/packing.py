"""Documents packed into containers of fixed capacity along a space-filling curve.

Sizes are in tokens: the matches of the published GPT-2 split pattern. Only a document larger than a
container is divided, into parts of full capacity. Each document's words are hashed into a vector, the
vector is projected to DIMENSIONS coordinates, and the position on the Hilbert curve through them is the
sort key: neighbours on the curve share vocabulary. Documents are range-partitioned and sorted by that
key, and each partition fills containers with a bounded window of open ones, best fit first, so that a
container holds neighbours and little space stays unused.

The key ends in a hash of the id, so that a third of all rows with one text, and so one key, is spread over
the ranges. Partitions stream through Arrow; a task holds its open containers only.

Cases: null, empty and blank texts of no tokens take no space and get no container (blank texts have
tokens by the pattern and are packed); ties on the key are broken by the id; repeated rows are packed
each; an empty table gives no container; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.stage import staged
from newsloom.llm import textvec as V
from newsloom.llm.similarity import slices

#: Fixed value: the published GPT-2 split pattern, with Unicode white space.
GPT2 = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS, DIMENSIONS, BITS = 256, 4, 8
#: Containers that a task keeps open at a time.
OPEN = 256


def n_tokens(text: Column) -> Column:
    """Number of tokens of a text, null for null."""
    return F.regexp_count(text, F.lit(GPT2))


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else np.uint64(0)
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


_PROJECTION = ((V.mix(np.arange(BUCKETS * DIMENSIONS, dtype=V.U) + V.P2) >> V.U(40)).astype(np.float64) / 2**24 - 0.5).reshape(BUCKETS, DIMENSIONS)


def curve_keys(texts: list[str | None]) -> np.ndarray:
    """Hilbert key of each text's hashed word vector."""
    w, off = V.words(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(off))
    bucket = (w >> V.U(56)).astype(np.int64)
    counts = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    vector = np.sqrt(counts)
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
    centred = vector - vector.mean(1, keepdims=True)
    place = np.clip((centred @ _PROJECTION) / 0.35 + 0.5, 0, 0.999999)
    return V.signed(hilbert_key((place * (1 << BITS)).astype(np.uint64), BITS))


def _key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1000):
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(curve_keys(b.column(2).to_pylist()))], names=["id", "tokens", "curve"])


class OpenContainers:
    """Best fit among the open containers; the fullest is closed when there are too many."""

    def __init__(self, capacity: int, most: int, start: int = 0):
        self.capacity, self.most, self.next = capacity, most, start
        self.by_room: dict[int, list[int]] = {}
        self.rooms = np.zeros(capacity + 1, bool)
        self.n = 0

    def place(self, size: int) -> int:
        fits = self.rooms[size : self.capacity]
        at = int(fits.argmax()) if len(fits) else 0
        if len(fits) and fits[at]:
            room = size + at
            which = self._take(room)
        else:
            room, which = self.capacity, self.next
            self.next += 1
        left = room - size
        if left:
            self.by_room.setdefault(left, []).append(which)
            self.rooms[left] = True
            self.n += 1
            if self.n > self.most:
                self._take(int(self.rooms.argmax()))
        return which

    def _take(self, room: int) -> int:
        held = self.by_room[room]
        which = held.pop(0)
        if not held:
            del self.by_room[room]
            self.rooms[room] = False
        self.n -= 1
        return which


def _fill(capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        held = OpenContainers(capacity, most)
        for b in batches:
            where = [held.place(n) for n in b.column(2).to_pylist()]
            where = pa.array(np.asarray(where, np.int64) + (part << 40))
            yield pa.RecordBatch.from_arrays([where, *b.columns[:5]], names=["container", "id", "part", "tokens", "start", "n_parts"])

    return run


def pack(df: DataFrame, id: str, text: str, capacity: int = 1024, open_containers: int = OPEN, partitions: int | None = None) -> DataFrame:
    """(container, id, part, tokens, start, n_parts): where each document, or part of one, goes.

    ``start`` is the first token of the part. No container holds more than ``capacity`` tokens.
    ``partitions``: number of ranges of the curve, by default Spark's number of shuffle partitions.
    """
    rows = df.select(df[id].alias("id"), df[text].alias("text"))
    rows = staged(rows, ["id", "text"], {"tokens": n_tokens(F.col("text"))}).where("tokens > 0")
    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.select("id", "tokens", "text").mapInArrow(_key, f"id {kind}, tokens int, curve long")
    n_parts = F.ceil(F.col("tokens") / capacity).cast("int")
    starts = F.sequence(F.lit(0), n_parts - 1)
    parts = keyed.select("id", "tokens", "curve", n_parts.alias("n_parts"), F.explode(starts).alias("part"))
    parts = parts.select(
        "id", "part", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("int").alias("tokens"),
        (F.col("part") * capacity).cast("int").alias("start"), "n_parts", "curve", F.xxhash64("id", "part").alias("tie"),
    )
    n = [partitions] if partitions else []
    ranged = parts.repartitionByRange(*n, "curve", "tie").sortWithinPartitions("curve", "tie", "id")
    return ranged.mapInArrow(_fill(capacity, open_containers), f"container long, id {kind}, part int, tokens int, start int, n_parts int")


def part_text(text: Column, start: Column, tokens: Column) -> Column:
    """The text of a part: its tokens joined, which gives back the text exactly."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(GPT2), F.lit(0)), start + 1, tokens), "")
