"""Training-set curation: positive and negative rows, noise from other documents, augmented documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import IMPOSSIBLE
from newsloom.session import checkpointed


def positive_negative(pairs: DataFrame, id: str, question: str, reverse: str, answer: str) -> DataFrame:
    """(id, question, response, positive): each row twice, once with its question and answer, once with the
    question that has none and the answer that says so."""
    rows = F.array(
        F.struct(F.col(question).alias("question"), F.col(answer).alias("response"), F.lit(True).alias("positive")),
        F.struct(F.col(reverse).alias("question"), F.lit(IMPOSSIBLE).alias("response"), F.lit(False).alias("positive")),
    )
    return pairs.select(F.col(id).alias("id"), F.inline(rows))


def hashed(*parts: Column | str) -> Column:
    """28 bits of sha1, a number that every engine computes alike."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 7), 16, 10).cast("long")


def numbered(docs: DataFrame, id: str) -> DataFrame:
    """``docs`` with n, 0-based numbers in the order of ``id``: ranges first, then positions within, so that no
    task orders all rows. The ranged rows are written once, since sizes and positions must come from the same ranges."""
    rows = docs.repartitionByRange(id).sortWithinPartitions(id).withColumn("__at", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    part = F.shiftright("__at", 33).alias("__part")  # the id holds the partition above 33 bits and the position below
    sizes = rows.groupBy(part).agg(F.count("*").alias("__size"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(w), F.lit(0)).alias("__before"))
    out = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.select(*docs.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("n"))


def noise_draws(docs: DataFrame, id: str, size: Column, want: int = 7, seed: str = "noise") -> DataFrame:
    """(id, slot, other): for documents with fewer than ``want`` chunks, as many other documents as are missing,
    drawn by hash and never the document itself. Without other documents there are none."""
    rows = numbered(docs.select(F.col(id).alias("id"), size.alias("m")), "id")
    total = docs.agg(F.count("*").alias("total"))
    short = rows.where(F.col("m") < want).crossJoin(F.broadcast(total)).where("total > 1")  # one row
    slots = short.select("id", "n", "total", F.explode(F.sequence(F.lit(0), F.lit(want - 1) - F.col("m"))).alias("slot"))
    step = F.pmod(hashed(F.col("id").cast("string"), F.col("slot").cast("string"), seed), F.col("total") - 1) + 1
    drawn = slots.select("id", "slot", F.pmod(F.col("n") + step, F.col("total")).alias("n"))
    return drawn.join(rows.select("n", F.col("id").alias("other")), "n").select("id", "slot", "other")


def pure_noise(rows: DataFrame, most: int = 7, share: float = 0.1, seed: str = "noise") -> DataFrame:
    """(id, body) for a hashed ``share`` of (id, chunks): chunks of 1 to ``most`` other documents, hashed in number
    and choice, and none of the document's own. Without other documents there are none."""
    every = numbered(rows.select("id"), "id")
    total = rows.agg(F.count("*").alias("total"))
    named = F.col("id").cast("string")
    chosen = every.where(hashed(named, seed + "-pure") < share * 2**28).crossJoin(F.broadcast(total)).where("total > 1")  # one row
    count = F.pmod(hashed(named, seed + "-count"), F.lit(most)) + 1
    slots = chosen.select("id", "n", "total", F.explode(F.sequence(F.lit(1), count.cast("int"))).alias("slot"))
    key = lambda tag: hashed(named, F.col("slot").cast("string"), seed + tag)
    drawn = slots.select("id", "slot", F.pmod(F.col("n") + F.pmod(key("-pure-other"), F.col("total") - 1) + 1, F.col("total")).alias("n"))
    others = drawn.join(every.withColumnRenamed("id", "other"), "n").join(rows.select(F.col("id").alias("other"), F.col("chunks").alias("theirs")), "other")
    pick = F.pmod(key("-pure-chunk"), F.size("theirs").cast("long")).cast("int")
    bodies = others.select("id", F.struct("slot", F.col("theirs")[pick].alias("x")).alias("s")).groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return bodies.select("id", F.array_join("s.x", "\n\n").alias("body"))


def with_noise(docs: DataFrame, id: str, chunks: Column, want: int = 7, seed: str = "noise", answer: Column | None = None, share: float = 0.1) -> DataFrame:
    """(id, kind, body, response): each document's first chunks in hashed order (og), for short ones also padded
    with a chunk of each drawn document (aug), and for a hashed ``share`` of all also chunks of other documents only
    (noise), whose response is IMPOSSIBLE in place of ``answer``. Without an answer, which noise is there to
    replace, the first two only and no response."""
    given = F.lit(None).cast("string") if answer is None else answer
    rows = docs.select(F.col(id).alias("id"), chunks.alias("chunks"), given.alias("response")).where(F.size("chunks") > 0)
    mine = F.slice("chunks", 1, want)
    order = lambda c, tag: F.array_join(F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.sha1(F.concat(x, F.lit(tag))).alias("h"), x.alias("x")))), lambda s: s["x"]), "\n\n")
    og = rows.select("id", F.lit("og").alias("kind"), order(mine, "og").alias("body"), "response")
    draws = noise_draws(rows, "id", F.size("chunks"), want, seed)
    other = rows.select(F.col("id").alias("other"), F.col("chunks").alias("theirs"))
    pick = F.pmod(hashed(F.col("id").cast("string"), F.col("slot").cast("string"), seed + "-chunk"), F.size("theirs").cast("long")).cast("int")
    noise = draws.join(other, "other").select("id", F.col("theirs")[pick].alias("chunk")).groupBy("id").agg(F.collect_list("chunk").alias("noise"))
    aug = rows.join(noise, "id").select("id", F.lit("aug").alias("kind"), order(F.concat(mine, "noise"), "aug").alias("body"), "response")
    if answer is None:
        return og.unionByName(aug).drop("response")
    pure = pure_noise(rows, want, share, seed).select("id", F.lit("noise").alias("kind"), "body", F.lit(IMPOSSIBLE).alias("response"))
    return og.unionByName(aug).unionByName(pure)


def augmented_docs(docs: DataFrame, rels: DataFrame, new_text: Column) -> tuple[DataFrame, DataFrame]:
    """(docs, rels) with a rewritten copy of each document under ids after the greatest, and its judgements."""
    top = docs.agg(F.max("doc_id").alias("top"))
    copies = numbered(docs, "doc_id").crossJoin(F.broadcast(top)).select(F.col("doc_id").alias("orig_id"), (F.col("top") + F.col("n") + 1).alias("doc_id"), new_text.alias("doc_text"))
    new_rels = rels.withColumnRenamed("doc_id", "orig_id").join(copies.select("orig_id", "doc_id"), "orig_id").select(*rels.columns)
    return docs.unionByName(copies.select("doc_id", "doc_text")), rels.unionByName(new_rels)


def balanced(base: DataFrame, numeric: DataFrame, generic: DataFrame, id: str, share: float = 0.25) -> DataFrame:
    """All of ``base``, of ``numeric`` as many as ``share`` of it, of ``generic`` as many as both, in hashed order; fewer
    where there are not so many."""
    n = base.count()
    some = min(int(share * n), numeric.count())
    order = F.sha1(F.col(id).cast("string")), F.col(id)
    return base.unionByName(numeric.orderBy(*order).limit(some)).unionByName(generic.orderBy(*order).limit(n + some))
