"""Queries that write a table in a format and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.catalog import load
from newsloom.session import shared_path
from newsloom.sources import tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select doc_id, text, category from documents where text is not null and text <> ''")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with line ends, quotes and commas through CSV."""
    path = shared_path(spark, "csv")
    tables.write_csv(load(spark, folder, "documents", "doc_id", "text", "category").where("text is not null and text <> ''"), path)
    return tables.read_csv(spark, path, "doc_id long, text string, category string")


@query("select c_custkey, c_name, c_mktsegment from customer")
def tsv_latin1(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated in the Latin-1 encoding."""
    path = shared_path(spark, "tsv")
    tables.write_csv(load(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment"), path, "\t", "ISO-8859-1")
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string", "\t", "ISO-8859-1")


@query("select n_nationkey::bigint as id, n_name as name, n_nationkey::varchar as doc, (select max(n_nationkey) from nation)::bigint as top from nation")
def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """JSON documents by key with an index, and the greatest id that is taken."""
    path = shared_path(spark, "documents")
    n = load(spark, folder, "nation", "n_nationkey", "n_name")
    tables.write_json_documents(n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("doc")), path, "doc")
    d = tables.read_json_documents(spark, path, "id long, name string", "doc")
    return d.join(F.broadcast(d.agg(F.max("id").alias("top"))), F.lit(True))  # one row


@query("select r_regionkey as region, count(*) as n from region join nation on n_regionkey = r_regionkey group by 1")
def text_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files, a key in each name, joined to rows by that key."""
    path = shared_path(spark, "texts")
    r = load(spark, folder, "region", "r_regionkey", "r_name")
    for key, text in r.collect():  # five rows: files are made one by one
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/region={key}")
    t = spark.read.text(path, wholetext=True).select(F.col("region").cast("int").alias("region"), F.col("value").alias("text")).where("text <> ''")
    n = load(spark, folder, "nation", "n_regionkey")
    return n.join(F.broadcast(t), n["n_regionkey"] == t["region"]).groupBy("region").agg(F.count("*").alias("n"))  # five rows


@query("select 'models' as name, count(*) as n from topic_model union all select 'summaries', count(*) from topic_summary")
def tables_together(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables that become visible together; a third version is written but not committed, and not seen."""
    at = shared_path(spark, "together")
    models, told = load(spark, folder, "topic_model", "id", "path"), load(spark, folder, "topic_summary", "topic", "summary")
    tables.write_together({"models": models.where("path < 'topics/8'"), "summaries": told.where("topic < 3")}, at, "first")
    tables.write_together({"models": models.where("path >= 'topics/8'"), "summaries": told.where("topic >= 3")}, at, "second")
    models.write.parquet(f"{at}/models/third")
    seen = {"models": "id string, path string", "summaries": "topic int, summary string"}
    parts = [tables.read_together(spark, at, n, s).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, s in seen.items()]
    return parts[0].unionByName(parts[1])


@query("""
    with k as (select arrival_no, md5(batch_no || chr(1) || arrival_no) as h from incoming_articles)
    select arrival_no, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as id from k""")
def keyed_inserts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows inserted batch by batch under ids made of what names them."""
    path = shared_path(spark, "inserts")
    t = load(spark, folder, "incoming_articles", "batch_no", "arrival_no")
    for part in (t.where("batch_no <= 6"), t.where("batch_no > 6")):
        tables.append(tables.with_key(part, F.col("batch_no").cast("string"), F.col("arrival_no").cast("string")).select("arrival_no", "id"), path)
    return spark.read.parquet(path)
