"""Queries on the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.catalog import load
from newsloom.llm import language, main_content, mixing, near_duplicates, packing, qa_defects, repeated_lines, splitting
from newsloom.llm.incremental import IncrementalIndex
from newsloom.llm.oracles import SQL as SQL


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = load(spark, folder, "scraped_articles", "id", "source", "body")
    return repeated_lines.repeated_lines(repeated_lines.chunks(articles))


def p4_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, its repeated lines, in how many documents they stand together, and the most of one."""
    articles = load(spark, folder, "scraped_articles", "id", "source", "body")
    cut = repeated_lines.chunks(articles)
    sources = cut.select("source", F.explode("wholes").alias("line")).distinct()
    found = repeated_lines.repeated_wholes(cut).join(sources, "line")
    return found.groupBy("source").agg(F.count("*").alias("n_lines"), F.sum("n_ids").alias("n_uses"), F.max("n_ids").alias("most"))


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's body without the lines repeated in its source, by its size and hash."""
    articles = load(spark, folder, "scraped_articles", "id", "source", "body").where("body is not null").distinct()
    clean = repeated_lines.without_repeated_lines(articles)
    return clean.select("id", F.length("clean_body").alias("n_chars"), F.md5("clean_body").alias("md5"))


QUERIES = {"p4_found": p4_found, "p4_sources": p4_sources, "p4_clean": p4_clean}


def _title_body():
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), "body")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = load(spark, folder, "scraped_articles", "id", "title", "body").where(F.col("body").rlike(r"(?U)\S"))
    return near_duplicates.near_duplicate_pairs(articles, "id", _title_body(), 0.5)


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per article with its class of equal texts, its group of near-duplicates and its links."""
    articles = load(spark, folder, "scraped_articles", "id", "title", "body").where(F.col("body").rlike(r"(?U)\S"))
    return near_duplicates.near_duplicate_groups(articles, "id", _title_body(), 0.8)


QUERIES |= {"p5_found": p5_found, "p5_groups": p5_groups}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    history = load(spark, folder, "cleaned_articles", "id", "url", "body")
    index = IncrementalIndex.build(history)
    rows = load(spark, folder, "incoming_articles", "batch_no", "arrival_no", "id", "url", "body")
    decided = index.ingest(rows, ["batch_no", "arrival_no"])
    index.drop()
    return decided.where("repeats").select("batch_no", "id").distinct()


QUERIES |= {"p6_found": p6_found}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = load(spark, folder, "scraped_articles", "id", "url", "source", "body", "html")
    return main_content.outside_lines(articles.where("html is not null and body is not null"))


def p1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's own text, also where its body is missing."""
    articles = load(spark, folder, "scraped_articles", "id", "url", "source", "body", "html")
    return main_content.main_text(articles).distinct()


QUERIES |= {"p1_found": p1_found, "p1_main_text": p1_main_text}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = load(spark, folder, "scraped_articles", "id", "body")
    cut = splitting.split_text(articles, "body").where("n_words > 512")
    return cut.select("id", splitting.boundary(F.col("pieces")).alias("boundary")).distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every body, with its boundary and size."""
    articles = load(spark, folder, "scraped_articles", "id", "body").distinct()
    return splitting.pieces(articles, "body", characters=100_000).select("id", "piece_no", "cut", "n_words", "n_overlap", F.length("text").alias("n_chars"))


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each body keep to: its words once each beside the overlaps, at most 512 in a piece and 64 repeated."""
    articles = load(spark, folder, "scraped_articles", "id", "body").where("body is not null").distinct()
    pieces = splitting.pieces(articles.withColumn("key", F.xxhash64("id", "body")), "body")
    kept = pieces.groupBy("id", "key").agg(
        F.sum(F.col("n_words") - F.col("n_overlap")).alias("n_words"), (F.max("n_words") <= 512).alias("within"), (F.max("n_overlap") <= 64).alias("overlaps_within"),
    )
    return kept.drop("key")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that the packing puts into several containers."""
    packed = packing.pack(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    spread = packed.groupBy("id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return spread.where("first < last").select(F.col("id").alias("doc_id"))


def p8_placement(spark: SparkSession, folder: str) -> DataFrame:
    """What the packing keeps to: every token placed once, no document divided but a larger one, no container overfull,
    at least 0.95 of the space used where there are a hundred containers or more."""
    packed = packing.pack(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    full = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("parts"))
    filled = full.agg(
        F.sum("t").alias("tokens"), F.sum("parts").alias("parts"), F.count_if(F.col("t") > 1024).alias("overfull"),
        ((F.count("*") < 100) | (F.sum("t") >= 0.95 * 1024 * F.count("*"))).alias("well_filled"),
    )
    docs = packed.groupBy("id").agg(F.sum("tokens").alias("t"), F.count("*").alias("parts"), F.countDistinct("part").alias("distinct_parts"))
    kept = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("t") <= 1024)).alias("divided_needlessly"), F.count_if(F.col("parts") != F.col("distinct_parts")).alias("placed_twice"))
    return filled.join(F.broadcast(kept), F.lit(True))  # one row each


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: containers, tokens and parts by twentieths of the capacity."""
    packed = packing.pack(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    full = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"))
    twentieth = F.ceil(F.col("tokens") * 20 / 1024).cast("int")
    return full.groupBy(twentieth.alias("twentieths")).agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("parts").alias("parts")
    )


QUERIES |= {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_totals": p2_totals, "p8_found": p8_found, "p8_placement": p8_placement, "p8_containers": p8_containers}


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, folder, "documents", "doc_id", "text", "source")
    return mixing.mix(documents, load(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1].where("not reachable").select("source")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, folder)[1]


def p9_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """What each source has, what it should reach and whether it can."""
    return _mixed(spark, folder)[1].select("source", "docs", "tokens", "target_tokens", "capacity", "reachable")


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents used, and how often."""
    return _mixed(spark, folder)[0].withColumnRenamed("id", "doc_id")


QUERIES |= {"p9_found": p9_found, "p9_report": p9_report, "p9_sizes": p9_sizes, "p9_selection": p9_selection}


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, folder, "documents", "doc_id", "text", "lang")
    return documents, language.judged(documents, language.fit(documents))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, parts = _judged(spark, folder)
    labels = documents.select("doc_id", language.label_language(F.col("lang")).alias("label")).distinct()
    lines = language.line_languages(parts.where(F.col("lang") != language.UNKNOWN)).withColumnRenamed("id", "doc_id").join(labels, "doc_id")
    return lines.where(F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("doc_id", "line_no", "lang").distinct()


def p10_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's language and confidence."""
    return language.document_languages(_judged(spark, folder)[1]).withColumnRenamed("id", "doc_id")


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each stretch of a document in one language."""
    return language.segments(_judged(spark, folder)[1]).withColumnRenamed("id", "doc_id")


QUERIES |= {"p10_found": p10_found, "p10_documents": p10_documents, "p10_segments": p10_segments}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = load(spark, folder, "augmented_qa", "qa_id", "context", "answerable", "unanswerable", "answer")
    profiles = language.fit(load(spark, folder, "documents", "doc_id", "text", "lang"))
    found = qa_defects.defects(pairs, profiles).where("defect is not null")
    return found.select(F.col("id").alias("qa_id"), "defect").distinct()


QUERIES |= {"p3_found": p3_found}
