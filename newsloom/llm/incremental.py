"""New batches against all accepted history, by an incremental inverted index of rare-token prefixes.

Tokens are five-word shingles; of a text with more than SAMPLE of them, those whose hash is below SAMPLE / n. Two
texts with similarity t or more have at least some number of tokens in common (of whole sets t (n + m) / (1 + t); of
sampled ones 4.5 standard deviations below what is expected of the least favourable partner), so they share one among all but so many of each
one's tokens, whatever the order of the tokens, as long as it is one order; the rarest come
first, so that those prefixes hardly ever meet by chance. The order is fitted when the index is built, by
counting every shingle of every text in a table of SLOTS counters (a shingle is as frequent as its slot),
and then frozen, so that old and new postings stay in one order.

The index is a folder below the shared one. Every text is cut into shingles once, when it comes, and never read
again:

* ``sets``, partitioned by ``part``: the shingle set of each class of equal texts, as the tasks that cut them write them;
* ``postings``, partitioned by ``bucket`` (of the token): blocks of packed postings, only ever appended; they name
  the part of each document;
* ``pages``, partitioned by ``slice``: the addresses that are taken;
* ``order``: the counters.

A probe reads only the buckets of its own prefix tokens, the parts of its candidates and the slices of its
addresses. Buckets and slices grow in number with the history that the index is built over, and parts have a bounded size, so a
batch reads at most as many of them as it has tokens, candidates and addresses, however long the history is.
Within a bucket, blocks are dealt to sub-buckets of about LIMIT postings, each against each, so that a hot token
is spread over tasks and no task holds more than two sub-buckets. Pairs are filtered by length and by a 32-byte sketch
of their shingles (4.5 standard deviations below t) and then verified on the whole sets, of
32-bit hashes (of two texts of 300 shingles, one of 50,000 pairs has a shingle more in common than it should).

``ingest`` takes any set of pending rows, one batch or many, and decides them in order: a row repeats if
something accepted before it, in the history or among earlier rows not themselves repeats, has a similar
text or an address that leads to the same page. Rows with equal shingle sets, and rows with the same
page, form classes that are aggregated, never paired. A few rounds decide whatever has no open relative before it; what
is left, chains of edits, is decided along each chain. The sets of rows that turn out to repeat stay behind, unused.

Cases: null, blank and short texts (under five words) match no text, not even an equal one; null and blank
addresses match none; a row that comes twice repeats itself; ties in the order are broken by id; an
empty history or batch gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import textvec as V
from newsloom.llm.similarity import BROADCAST_ROWS, set_hash, slices
from newsloom.operators.graphs import connected_components
from newsloom.operators.urls import canonical_url
from newsloom.session import checkpointed, shared_path

#: Counters of the frozen order: a bound on what is sent to every executor (4 bytes each).
SLOTS = 1 << 20
#: Tokens that are sampled of a longer text, about.
SAMPLE = 64
#: Documents per bucket, part and slice, about.
DOCS_PER_BUCKET = 20_000
#: Postings of a sub-bucket, about: what one task matches against as many.
LIMIT = 500_000
#: So many partitions are named to the reader; beyond, their numbers are joined.
NAMED = 10_000
#: Rounds before what is open is decided chain by chain, and the longest chain that one task takes.
ROUNDS, CHAIN = 3, 100_000

_BLOCK = "bucket int, held int, token binary, doc binary, part binary, size binary, sketch binary, at binary"
_PACKED = ["token", "doc", "part", "size", "sketch", "at"]
_SETS = "key {}, page string, doc long, n int, shingles binary"


# ---- shingle sets of 32 bits, as differences of 24

_FULL = (1 << 24) - 1


def pack_sets(h: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Each sorted set as 3-byte differences; a longer one is told by full steps before it."""
    v = h >> V.U(32)
    step = np.diff(v, prepend=V.U(0))
    first = off[:-1][np.diff(off) > 0]
    step[first] = v[first]
    full = (step // V.U(_FULL)).astype(np.int64)
    n = np.diff(off)
    at = np.concatenate([[0], np.cumsum(full + 1)])
    out = np.full(at[-1], _FULL, "<u4")
    out[at[1:] - 1] = (step % V.U(_FULL)).astype(np.uint32)
    data, bounds = np.ascontiguousarray(out.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes(), at[off] * 3
    return [data[i:j] for i, j in zip(bounds[:-1], bounds[1:])] if len(n) else []


def unpack_sets(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all sets, each sorted, and their offsets."""
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(x) // 3 for x in data], out=held[1:])
    wide = np.zeros((held[-1], 4), np.uint8)
    wide[:, :3] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 3)
    raw = wide.view("<u4").ravel()
    total = np.concatenate([[V.U(0)], np.cumsum(raw.astype(V.U))])
    value = total[1:] - np.repeat(total[held[:-1]], np.diff(held))
    real = raw != _FULL
    return value[real], np.concatenate([[0], np.cumsum(real)])[held]


def _cut(stamp: int, per_part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, page, doc, n, shingles, part) of (key, page, text): the set only where the task meets the class for the first time."""
        task = TaskContext.get()
        seen: dict[int, int] = {}
        base, rows = (stamp << 32) + ((task.partitionId() if task else 0) << 12), 0
        for b in slices(batches, 1000):
            h, off = V.shingles(b.column(2).to_pylist())
            n = np.diff(off)
            doc = V.signed(set_hash(h, off))
            part, sets = base + rows // per_part, pack_sets(h, off)
            rows += b.num_rows
            parts = []
            for i, d in enumerate(doc.tolist()):
                if not n[i] or d in seen:
                    sets[i] = None
                else:
                    seen[d] = part
                parts.append(part)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(doc, mask=n == 0), pa.array(n.astype(np.int32)), pa.array(sets, pa.binary()), pa.array(parts, pa.int64())],
                names=["key", "page", "doc", "n", "shingles", "part"],
            )

    return run


# ---- the order of tokens


def _slot(h: np.ndarray) -> np.ndarray:
    return (V.mix(h ^ V.P1) >> V.U(44)).astype(np.int64)


PIECES = 64


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of a task, in PIECES."""
    total = np.zeros(SLOTS, np.int64)
    some = False
    for b in slices(batches, 2000):
        h, _ = unpack_sets([x for x in b.column(0).to_pylist() if x is not None])
        total += np.bincount(_slot(h), minlength=SLOTS)
        some = some or len(h) > 0
    if some:
        rows = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in total.reshape(PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([zlib.crc32(r) % 64 for r in rows], pa.int32()), pa.array(rows, pa.binary())], names=["piece", "spread", "counters"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in table.column("counters").to_pylist())
    return pa.table({"piece": table.column("piece").slice(0, 1), "counters": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _by_rarity(h: np.ndarray, off: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """The shingles of each text, rarest first."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return h[np.lexsort((h, counters[_slot(h)], doc))]


# ---- postings

BINS = 64
_LOW = V.U(0x1111111111111111)


def sketches(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, 4) words: the least hash in each of 64 bins, cut to a nibble that is 0 only for empty bins."""
    n = len(off) - 1
    x = V.mix(h ^ V.P1)
    least = np.full(n * BINS, ~V.U(0))
    np.minimum.at(least, np.repeat(np.arange(n), np.diff(off)) * BINS + (x >> V.U(58)).astype(np.int64), x << V.U(6))
    nibble = np.where(least == ~V.U(0), V.U(0), V.mix(least) % V.U(15) + V.U(1)).reshape(n, 4, 16)
    return (nibble << (V.U(4) * np.arange(16, dtype=V.U))).sum(2, dtype=V.U)


def _least_agreeing(threshold: float) -> int:
    return int(BINS * (threshold + (1 - threshold) / 15) - 4.5 * np.sqrt(BINS * threshold * (1 - threshold)))


def prefix_lengths(n: np.ndarray, sampled: np.ndarray, threshold: float) -> np.ndarray:
    """How many of a text's sampled tokens, in the frozen order, must be looked up."""
    least = np.full(len(n), np.inf)
    for m in (np.ceil(threshold * n), n, np.floor(n / threshold)):
        rate = np.minimum(1.0, SAMPLE / np.maximum(np.maximum(n, m), 1))
        common = np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9) * rate
        least = np.minimum(least, common - 4.5 * np.sqrt(common * (1 - rate)))
    return np.where(sampled > 0, sampled - np.maximum(1, np.floor(least + 1e-9)).astype(np.int64) + 1, 0).clip(0)


def tokens(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sampled shingles of each text, and their offsets."""
    n = np.diff(off)
    rate = np.minimum(1.0, SAMPLE / np.maximum(n, 1))
    keep = (V.mix(h ^ V.P2) >> V.U(11)).astype(np.float64) / 2**53 < np.repeat(rate, n)
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def _pack_tokens(low: np.ndarray) -> bytes:
    """Sorted 32-bit tokens as deflated byte planes of their differences."""
    step = np.diff(low, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_tokens(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _post(shared, buckets: int, threshold: float):
    """Posting blocks of (doc, shingles, part)."""

    def flush(parts):
        token, doc = (np.concatenate([p[i] for p in parts]) for i in range(2))
        names, where, size, sketch = (np.concatenate([p[i] for p in parts]) for i in range(2, 6))
        token = V.mix(token)
        bucket = (token >> V.U(32)) % V.U(buckets)
        low = token.astype(np.uint32)
        order = np.lexsort((low, bucket))
        bucket, low, doc = bucket[order], low[order], doc[order]
        ids, first = np.unique(bucket, return_index=True)
        for u, lo, hi in zip(ids, first, [*first[1:], len(bucket)]):
            for i in range(lo, hi, LIMIT):
                j = min(hi, i + LIMIT)
                docs, at = np.unique(doc[i:j], return_inverse=True)
                at = at.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32)
                held = zlib.compress(where[docs].tobytes(), 1)
                yield int(u), int(j - i), _pack_tokens(low[i:j]), names[docs].tobytes(), held, size[docs].tobytes(), sketch[docs].tobytes(), at.tobytes()

    def run(batches):
        parts, held, docs = [], 0, 0

        def out():
            for r in flush(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0]], pa.int32()), pa.array([r[1]], pa.int32()), *[pa.array([x], pa.binary()) for x in r[2:]]],
                    names=[x.split()[0] for x in _BLOCK.split(", ")],
                )

        for b in slices(batches, 1000):
            if not b.num_rows:
                continue
            h, off = unpack_sets(b.column(1).to_pylist())
            n = np.diff(off)
            t, toff = tokens(h, off)
            count = np.diff(toff)
            t = _by_rarity(t, toff, shared.value)
            keep = np.arange(len(t)) - np.repeat(toff[:-1], count) < np.repeat(prefix_lengths(n, count, threshold), count)
            parts.append((t[keep], (np.repeat(np.arange(len(n)), count) + docs)[keep], b.column(0).to_numpy().view(V.U), b.column(2).to_numpy(), n.astype(np.int32), sketches(h, off)))
            docs += len(n)
            held += int(keep.sum())
            if held > 2_000_000:
                yield from out()
                parts, held, docs = [], 0, 0
        if held:
            yield from out()

    return run


def _unpack(table: pa.Table):
    """(tokens, document of each) and (documents, parts, sizes, sketches, whether stored) of blocks."""
    columns, n = [[] for _ in range(7)], 0
    for t, d, p, s, k, a, o in zip(*(table.column(c).to_pylist() for c in [*_PACKED, "stored"])):
        low, docs = _unpack_tokens(t), np.frombuffer(d, V.U)
        at = np.frombuffer(a, np.uint16 if len(a) == 2 * len(low) else np.uint32).astype(np.uint32) + np.uint32(n)
        each = low, at, docs, np.frombuffer(zlib.decompress(p), np.int64), np.frombuffer(s, np.int32), np.frombuffer(k, V.U).reshape(-1, 4), np.full(len(docs), o)
        for c, x in zip(columns, each):
            c.append(x)
        n += len(docs)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, V.U), np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, 4), V.U), np.empty(0, bool)
    return tuple(np.concatenate(c) for c in columns)


def _match(threshold: float):
    least = _least_agreeing(threshold)

    def run(probe: pa.Table, index: pa.Table) -> pa.Table:
        tx, ax, dx, px, nx, kx, _ = _unpack(probe)
        ty, ay, dy, py, ny, ky, oy = _unpack(index)
        order = np.argsort(ty, kind="stable")
        ty, ay = ty[order], ay[order]
        lo, hi = np.searchsorted(ty, tx, "left"), np.searchsorted(ty, tx, "right")
        hits = np.flatnonzero(hi > lo)
        upto = np.cumsum(hi[hits] - lo[hits])
        found = []
        i = 0
        while i < len(hits):  # about a million matches at a time
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + 1_000_000)))
            h = hits[i:j]
            c = hi[h] - lo[h]
            left = np.repeat(ax[h], c)
            right = ay[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[h], c)]
            m, n = nx[left], ny[right]
            # Against what is stored, an equal text counts too; pending texts are paired once, lesser first.
            fit = (np.minimum(m, n) >= threshold * np.maximum(m, n)) & (oy[right] | (dx[left] < dy[right]))
            left, right = left[fit], right[fit]
            x = kx[left] ^ ky[right]
            x |= x >> V.U(1)
            x |= x >> V.U(2)
            fit = np.bitwise_count(x & _LOW).sum(1) <= BINS - least
            found.append(np.unique((left[fit].astype(V.U) << V.U(32)) | right[fit]))
            i = j
        both = np.unique(np.concatenate(found)) if found else np.empty(0, V.U)
        left, right = (both >> V.U(32)).astype(np.int64), (both & V.U(0xFFFFFFFF)).astype(np.int64)
        return pa.table({"a": pa.array(V.signed(dx[left])), "b": pa.array(V.signed(dy[right])), "pa": pa.array(px[left]), "pb": pa.array(py[right]), "stored": pa.array(oy[right])})

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            x, xo = unpack_sets(b.column(2).to_pylist())
            y, yo = unpack_sets(b.column(3).to_pylist())
            m, n = np.diff(xo), np.diff(yo)
            # One sorted list of (pair, shingle): a shingle of both sets stands there twice.
            pair = np.concatenate([np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(n)), n)])
            value = np.concatenate([x, y])
            order = np.lexsort((value, pair))
            pair, value = pair[order], value[order]
            twice = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
            common = np.bincount(pair[1:][twice], minlength=len(m))
            yield b.select([0, 1]).filter(pa.array((common > 0) & (common >= threshold * (m + n - common))))

    return run


def _chain(rows: pa.Table, near: pa.Table) -> pa.Table:
    """Rows of one chain, decided in order: (node, repeats)."""
    beside: dict[int, list[int]] = {}
    for a, b in zip(near.column("x").to_pylist(), near.column("y").to_pylist()):
        beside.setdefault(a, []).append(b)
    docs, pages, out = set(), set(), []
    node, doc, page = (rows.column(c).to_pylist() for c in ("id", "doc", "page"))
    for i in np.argsort(np.array(rows.column("place").to_pylist(), np.int64), kind="stable"):
        repeats = doc[i] in docs or page[i] in pages or any(d in docs for d in beside.get(doc[i], ()))
        out.append((node[i], repeats))
        if not repeats:
            docs |= {doc[i]} - {None}
            pages |= {page[i]} - {None}
    return pa.table({"id": pa.array([x for x, _ in out], pa.string()), "verdict": pa.array([x for _, x in out], pa.bool_())})


def _page_key(page):
    return F.xxhash64(F.lit("page"), page)


def _keys():
    """What a row shares with others: its class of equal texts and its page."""
    return F.array_compact(F.array(F.col("doc"), F.when(F.col("page").isNotNull(), _page_key(F.col("page")))))


class IncrementalIndex:
    """The index of what is accepted, in ``path``; ``threshold`` is the similarity that makes a repeat."""

    def __init__(self, spark: SparkSession, path: str, threshold: float, buckets: int, per_part: int = DOCS_PER_BUCKET):
        self.spark, self.path, self.threshold, self.buckets, self.per_part = spark, path, threshold, buckets, per_part
        counters = np.zeros((PIECES, SLOTS // PIECES), np.int64)
        for r in self.read("order", "piece int, counters binary").collect():  # SLOTS counters
            counters[r[0]] = np.frombuffer(zlib.decompress(r[1]), "<i8")
        self.order = spark.sparkContext.broadcast(np.minimum(counters.ravel(), 2**31 - 1).astype(np.int32))

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def hit(self, name: str, schema: str, key: str, keys: DataFrame) -> DataFrame:
        """The partitions of a table whose ``key`` is among ``keys``; the others are not read."""
        keys = keys.distinct()
        wanted = [r[0] for r in keys.limit(NAMED + 1).collect()]
        table = self.read(name, f"{schema}, {key} {'long' if key == 'part' else 'int'}")
        if len(wanted) > NAMED:
            return table.join(keys.toDF(key), key, "left_semi")
        return table.where(F.col(key).isin(sorted(wanted)) if wanted else F.lit(False))

    def drop(self) -> None:
        """Remove the index's folder. What ``ingest`` gave back does not need it."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    @classmethod
    def build(cls, history: DataFrame, path: str | None = None, id: str = "id", url: str = "url", text: str = "body", threshold: float = 0.5, docs_per_bucket: int = DOCS_PER_BUCKET):
        """A new index over ``history``, the accepted documents."""
        spark = history.sparkSession
        path = path or shared_path(spark, "index")
        buckets = max(8, history.count() // docs_per_bucket)
        rows = history.select(F.lit(0).alias("key"), canonical_url(history[url]).alias("page"), history[text].alias("text"))
        sets = cls._store(spark, rows, path, docs_per_bucket)
        each = sets.select("shingles").where("shingles is not null").mapInArrow(_count, "piece int, spread int, counters binary")
        for keys in (["piece", "spread"], ["piece"]):  # in two steps, so that no task sums those of all tasks
            each = each.groupBy(*keys).applyInArrow(_sum, "piece int, counters binary")
            if len(keys) == 2:
                each = each.withColumn("spread", F.lit(0))
        each.coalesce(1).write.parquet(f"{path}/order")
        index = cls(spark, path, threshold, buckets, docs_per_bucket)
        index._accept(sets, sets.select("page"))
        return index

    @staticmethod
    def _store(spark: SparkSession, rows: DataFrame, path: str, per_part: int) -> DataFrame:
        """Rows (key, page, text) cut and written to the index, read back: each part is written by the task that cuts it."""
        kind = rows.schema["key"].dataType.simpleString()
        stamp = uuid.uuid4().int >> 97  # 31 bits
        rows.mapInArrow(_cut(stamp, per_part), f"{_SETS.format(kind)}, part long").write.mode("append").partitionBy("part").parquet(f"{path}/sets")
        every = spark.read.schema(f"{_SETS.format(kind)}, part long").parquet(f"{path}/sets")
        return every.where((F.col("part") >= stamp << 32) & (F.col("part") < (stamp + 1) << 32))

    def _accept(self, sets: DataFrame, pages: DataFrame) -> None:
        """Postings of accepted sets, and the pages that are taken."""
        self.blocks(sets).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        pages = pages.where("page is not null").distinct().withColumn("slice", self._slice(F.col("page")))
        pages.repartition("slice").write.mode("append").partitionBy("slice").parquet(f"{self.path}/pages")

    def _slice(self, page):
        return F.pmod(F.xxhash64(page), F.lit(self.buckets)).cast("int")

    def blocks(self, sets: DataFrame) -> DataFrame:
        """Posting blocks of rows with doc, shingles and part."""
        return sets.where("shingles is not null").select("doc", "shingles", "part").mapInArrow(_post(self.order, self.buckets, self.threshold), _BLOCK)

    def _grid(self, probe: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(stored blocks of the probe's buckets, (bucket, np, ni): into how many sub-buckets probe and all blocks are dealt).

        The sizes of NAMED buckets at most pass through the driver as numbers; beyond, they are joined."""
        schema = _BLOCK.replace("bucket int, ", "")
        mine = probe.groupBy("bucket").agg(F.sum("held").alias("m"))
        sizes = {r[0]: r[1] for r in mine.limit(NAMED + 1).collect()}
        if len(sizes) > NAMED:
            stored = self.hit("postings", schema, "bucket", probe.select("bucket"))
            other = stored.groupBy("bucket").agg(F.sum("held").alias("o"))
            n = lambda c: F.ceil(c / LIMIT).cast("int")
            both = mine.join(other, "bucket", "left")
            return stored, both.select("bucket", n(F.col("m")).alias("np"), n(F.col("m") + F.coalesce("o", F.lit(0))).alias("ni"))
        table = self.read("postings", f"{schema}, bucket int")
        stored = table.where(F.col("bucket").isin(sorted(sizes)) if sizes else F.lit(False))
        other = {r[0]: r[1] for r in stored.groupBy("bucket").agg(F.sum("held")).collect()}
        rows = [(b, -(-m // LIMIT), -(-(m + other.get(b, 0)) // LIMIT)) for b, m in sizes.items()]
        return stored, F.broadcast(self.spark.createDataFrame(rows, "bucket int, np int, ni int"))

    def candidates(self, probe: DataFrame) -> DataFrame:
        """(a, b, pa, pb, stored): classes of the probe blocks and of stored or other probe blocks that share a prefix
        token and fit, and their parts."""
        stored, grid = self._grid(probe)
        every = stored.withColumn("stored", F.lit(True)).unionByName(probe.withColumn("stored", F.lit(False)))
        deal = lambda c: F.pmod(F.xxhash64("token"), F.col(c)).cast("int")
        to_all = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = probe.withColumn("stored", F.lit(False)).join(grid, "bucket").withColumn("p", deal("np")).withColumn("i", to_all("ni"))
        right = every.join(grid, "bucket").withColumn("i", deal("ni")).withColumn("p", to_all("np"))
        keys = ["bucket", "p", "i"]
        left, right = (x.select(*keys, *_PACKED, "stored").groupBy(*keys) for x in (left, right))
        pairs = left.cogroup(right).applyInArrow(_match(self.threshold), "a long, b long, pa long, pb long, stored boolean")
        return pairs.groupBy("a", "b", "stored").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"))

    def near(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((doc) of pending classes that repeat a stored one, (a, b) verified links between other pending classes).

        A class that is stored itself repeats without a look at its set, and what repeats the stored ones is no longer
        compared with what is pending.
        """
        probe = checkpointed(self.blocks(sets))
        pairs = checkpointed(self.candidates(probe))
        same = pairs.where("stored and a = b").select("a").distinct()
        old = checkpointed(self.verified(pairs.where("stored and a <> b").join(same, "a", "left_anti")).select("a"))
        hits = same.union(old).distinct()
        new = pairs.where("not stored").join(hits, "a", "left_anti").join(hits.toDF("b"), "b", "left_anti")
        return hits.toDF("doc"), self.verified(new)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (a, b, pa, pb) that are as similar as the threshold asks."""
        pairs = checkpointed(pairs)
        ends = pairs.select(F.col("a").alias("doc"), F.col("pa").alias("part")).union(pairs.select("b", "pb")).distinct()
        kept = self.hit("sets", "doc long, shingles binary", "part", ends.select("part")).where("shingles is not null")
        docs = ends.select("doc").distinct()
        wanted = kept.join(F.broadcast(docs) if 2 * pairs.count() <= BROADCAST_ROWS else docs, "doc", "left_semi")
        wanted = wanted.groupBy("doc").agg(F.first("shingles").alias("shingles"))
        both = pairs.select("a", "b").join(wanted.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
        both = both.join(wanted.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_verify(self.threshold), "a long, b long")

    def ingest(self, rows: DataFrame, order: list[str], id: str = "id", url: str = "url", text: str = "body") -> DataFrame:
        """(order..., id, repeats) for every pending row; what is new is appended to the index."""
        seq = F.struct(*[rows[c].alias(f"o{i}") for i, c in enumerate(order)], rows[id].cast("string").alias("rid"))
        work = rows.select(seq.alias("seq"), canonical_url(rows[url]).alias("page"), rows[text].alias("text"))
        cut = self._store(self.spark, work.select(F.col("seq").alias("key"), "page", "text"), self.path, self.per_part)
        facts = cut.select(F.col("key").alias("seq"), F.xxhash64("key").cast("string").alias("id"), "doc", "page")
        hits, near = self.near(cut)
        near = checkpointed(near)

        asked = facts.where("page is not null").select("page").distinct()
        taken = self.hit("pages", "page string", "slice", asked.select(self._slice(F.col("page"))))
        taken = taken.select("page").join(asked, "page", "left_semi").select(_page_key(F.col("page")).alias("key"))
        old = hits.select(F.col("doc").alias("key")).union(taken).distinct().withColumn("old", F.lit(True))
        each = facts.select("seq", "id", "doc", "page", F.explode_outer(_keys()).alias("key")).join(old, "key", "left")
        state = each.groupBy("seq", "id", "doc", "page").agg(F.max("old").alias("repeats"))
        decided = self._decide(state, near)
        fresh = decided.where("not repeats")
        self._accept(cut.join(fresh.select("doc").distinct(), "doc", "left_semi"), fresh.select("page"))
        return decided.select(*[F.col("seq")[f"o{i}"].alias(c) for i, c in enumerate(order)], F.col("seq")["rid"].alias(id), "repeats")

    @staticmethod
    def _decide(state: DataFrame, near: DataFrame) -> DataFrame:
        """Rounds: a row with an accepted relative before it repeats, one with no open relative before it is new.
        What is open after ROUNDS of them is decided in order, each connected chain in one task, unless one is over CHAIN
        rows: then more rounds shorten it first."""
        near = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        state = checkpointed(state)
        while True:
            for _ in range(ROUNDS):
                state = checkpointed(IncrementalIndex._round(state, near))
                if state.where("repeats is null").isEmpty():
                    return state
            state = checkpointed(IncrementalIndex._round(state, near, False))  # none left open has an accepted relative before it
            left = state.where("repeats is null")
            page = _page_key(F.col("page"))
            open_docs = left.where("doc is not null").select("doc").distinct()
            links = near.join(open_docs.select(F.col("doc").alias("a")), "a", "left_semi").join(open_docs.select(F.col("doc").alias("b")), "b", "left_semi")
            node = F.xxhash64(F.lit("row"), "id")
            edges = left.where("doc is not null").select(node.alias("a"), F.col("doc").alias("b"))
            edges = edges.union(left.where("page is not null").select(node, page)).union(links.select("a", "b"))
            parts = checkpointed(connected_components(edges))
            rows = left.withColumn("node", node).join(parts, "node").withColumn("size", F.lit(1))
            most = rows.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            if most is None or most > CHAIN:
                continue
            w_links = links.select(F.col("a").alias("x"), F.col("b").alias("y")).join(parts.select(F.col("node").alias("x"), F.col("component").alias("chain")), "x").select("chain", "x", "y")
            place = F.row_number().over(Window.partitionBy("component").orderBy("seq"))  # at most CHAIN rows
            rows = rows.withColumn("place", place).select("component", "id", "doc", "page", "place")
            verdict = rows.groupBy("component").cogroup(w_links.groupBy("chain")).applyInArrow(_chain, "id string, verdict boolean")
            return checkpointed(state.join(verdict, "id", "left").select("seq", "id", "doc", "page", F.coalesce("repeats", "verdict").alias("repeats")))

    @staticmethod
    def _round(state: DataFrame, near: DataFrame, accept: bool = True) -> DataFrame:
        acc, unk = F.col("repeats") == False, F.col("repeats").isNull()  # noqa: E712
        each = state.select("seq", "repeats", F.explode(_keys()).alias("key"))
        least = each.groupBy("key").agg(F.min(F.when(acc, F.col("seq"))).alias("acc"), F.min(F.when(unk, F.col("seq"))).alias("unk"))
        via = near.join(least.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"), "acc", "unk")
        told = least.unionByName(via).groupBy("key").agg(F.min("acc").alias("acc"), F.min("unk").alias("unk"))
        seen = state.where(unk).select("seq", "id", "doc", "page", F.explode_outer(_keys()).alias("key")).join(told, "key", "left")
        seen = seen.groupBy("seq", "id", "doc", "page").agg(F.min("acc").alias("acc"), F.min("unk").alias("unk"))
        before = lambda x: F.coalesce(F.col(x) < F.col("seq"), F.lit(False))
        verdict = F.when(before("acc"), F.lit(True)).when(~before("unk") & F.lit(accept), F.lit(False))
        return state.where(~unk).unionByName(seen.select("seq", "id", "doc", "page", verdict.alias("repeats")))
