"""Queries on the timestamp operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.catalog import load
from newsloom.operators.timestamps import normalise_timestamps


def _normalised(spark: SparkSession, folder: str) -> DataFrame:
    articles = load(spark, folder, "scraped_articles", "id", "source", "published")
    return normalise_timestamps(articles, load(spark, folder, "news_sources", "source", "home_tz", "date_order"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _normalised(spark, folder)
        .where(
            F.col("source").isNotNull()
            & F.col("utc_us").isNotNull()
            & ~F.col("published").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
        )
        .select("id", "utc_us")
        .distinct()
    )


def p7_notations(spark: SparkSession, folder: str) -> DataFrame:
    """How often each notation occurs, and the span of instants it gives."""
    return (
        _normalised(spark, folder)
        .groupBy(F.coalesce("utc_pattern", F.lit("none")).alias("notation"))
        .agg(F.count("*").alias("n"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us"))
    )


QUERIES = {"p7_found": p7_found, "p7_notations": p7_notations}
