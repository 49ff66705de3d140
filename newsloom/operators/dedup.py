"""Exact and near-duplicate removal of articles by shingles, MinHash and banding."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.stage import staged
from newsloom.functions.text import tokens
from newsloom.operators.graphs import connected_components
from newsloom.session import checkpointed

SHINGLE, SIGNATURE, BANDS, THRESHOLD, SEED = 10, 50, 10, 0.5, 1631996
PRIME = 2_147_483_647
#: Members of a key in a block, about: a task joins one block with another.
SPLIT = 2_000
#: Up to so many rows a table of keys is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 200_000


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def versions(df: DataFrame, id: str, *columns: str, out: str = "doc") -> DataFrame:
    """(out, columns...) of distinct rows: the id with the number of its version, in the order of the columns, so that no
    version of an id is lost and no column meets another row's."""
    rows = df.select(id, *columns).distinct()
    n = F.row_number().over(Window.partitionBy(id).orderBy(*columns))  # the versions of one id
    return rows.select(F.concat_ws("#", F.col(id).cast("string"), n.cast("string")).alias(out), *columns)


def shingles(t: Column, k: int = SHINGLE) -> Column:
    """Distinct runs of ``k`` of the tokens; none for fewer. ``t`` must be a column, not an expression: a lambda
    evaluates what it closes over for every element."""
    runs = F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.array_join(F.slice(t, i + 1, k), " "))
    return F.when(F.size(t) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shingle_hash(x: Column) -> Column:
    """31-bit number of a shingle, from sha1, so that every engine gives the same."""
    return F.conv(F.right(F.sha1(x), F.lit(8)), 16, 10).cast("long") % PRIME


def permutations(n: int = SIGNATURE, seed: int = SEED) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, 1 << 30), rng.randrange(0, PRIME)) for _ in range(n)]


def signatures(docs: DataFrame, n: int = SIGNATURE) -> DataFrame:
    """(doc, sig): MinHash signatures by ``n`` affine permutations of the shingle numbers. Texts without
    shingles have none. One explode and one combined aggregation."""
    cut = staged(docs, ["doc"], {"t": tokens(F.col("text"))})
    each = cut.select("doc", F.explode(shingles(F.col("t"))).alias("s")).select("doc", shingle_hash(F.col("s")).alias("h"))
    mins = [F.min((F.col("h") * a + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(permutations(n))]
    return each.groupBy("doc").agg(*mins).select("doc", F.array(*[f"m{i}" for i in range(n)]).alias("sig"))


def salted_signatures(docs: DataFrame, n: int = SIGNATURE, k: int = SHINGLE) -> DataFrame:
    """(doc, sig) as ``signatures``, by the first sixty bits of sha1 of a salt and the shingle: slower, any number of functions."""
    cut = staged(docs, ["doc"], {"t": tokens(F.col("text"))})
    each = cut.select("doc", F.explode(shingles(F.col("t"), k)).alias("s"))
    salted = lambda i: F.conv(F.substring(F.sha1(F.concat(F.lit(f"{i}-"), F.col("s"))), 1, 15), 16, 10).cast("long")
    mins = [F.min(salted(i)).alias(f"m{i}") for i in range(n)]
    return each.groupBy("doc").agg(*mins).select("doc", F.array(*[f"m{i}" for i in range(n)]).alias("sig"))


def bucket_pairs(keys: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b), a < b: the pairs of docs that share a key, each once, of distinct rows (key, doc).

    Members are counted before they are joined. Most keys have one member and go; one of two gives its pair at once; of
    the keys with the very same members, as the many keys that near copies share, one is kept. The members of what is left
    are dealt to blocks of about ``split`` and each block is joined with each, so that a hot key is spread over tasks.
    """
    each = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"),
        F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("y"),
    ).where("n > 1")
    each = checkpointed(each)
    two = each.where("n = 2").select("a", "b")
    kept = checkpointed(each.where("n > 2").groupBy("n", "a", "b", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    small = kept.count() <= BROADCAST_ROWS
    members = keys.join(F.broadcast(kept) if small else kept, "key").withColumn("blocks", F.ceil(F.col("n") / split).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    left = members.select("key", F.col("doc").alias("u"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = members.select("key", F.col("doc").alias("v"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    more = left.join(right, ["key", "i", "j"]).where("u <> v and (i < j or u < v)").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return two.unionByName(more).distinct()


def candidate_pairs(sigs: DataFrame, bands: int = BANDS, n: int = SIGNATURE) -> DataFrame:
    """(a, b), a < b: texts that agree in a band, by a hash of the band and its numbers."""
    rows = n // bands
    hashes = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * rows + 1, rows)) for i in range(bands)])
    return bucket_pairs(sigs.select("doc", F.explode(hashes).alias("key")))


def verified_pairs(sigs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): pairs whose signatures are similar as sets."""
    both = pairs.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a")
    both = both.join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
    j = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return both.select("a", "b", j.alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(docs: DataFrame) -> DataFrame:
    sigs = checkpointed(signatures(docs))
    return verified_pairs(sigs, candidate_pairs(sigs))


def near_duplicate_removal(docs: DataFrame) -> DataFrame:
    """(doc, component) of the rows kept of ``docs`` (doc, body, text, known): one per body, then one per
    component of similar texts, known rows first and then the least doc; known rows are left out at the end."""
    order = F.col("known").desc(), F.col("doc")
    unique = checkpointed(keep_first(docs, ["body"], *order))
    found = connected_components(similar_pairs(unique.select("doc", "text")).select("a", "b"))
    with_group = unique.select("doc", "known").join(found, unique["doc"] == found["node"], "left")
    with_group = with_group.select("doc", "known", F.coalesce("component", "doc").alias("component"))
    return keep_first(with_group, ["component"], *order).where(~F.col("known")).select("doc", "component")
