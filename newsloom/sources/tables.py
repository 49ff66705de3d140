"""Reading and writing: formats, buffered appends, keyed upserts, indexed file sets, tables that appear together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old`` by key: rows of ``old`` with a new version go."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def with_key(df: DataFrame, *parts: Column, name: str = "id") -> DataFrame:
    """``df`` with an id like a UUID, made of what names the row, so that a task that runs again gives the same."""
    h = F.md5(F.concat_ws("\u0001", *parts))
    cut = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return df.withColumn(name, F.concat_ws("-", *cut))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV or TSV with a header; quoted fields may hold line ends."""
    r = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    r = r.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return (r.schema(schema) if schema else r).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    df.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"').csv(path)


def append(df: DataFrame, path: str) -> None:
    """All rows, with no tail left in a buffer; parallel by partition."""
    df.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str, input: str, output: str) -> None:
    """Lines {"input_text": ..., "output_text": ...}."""
    row = F.to_json(F.struct(F.col(input).alias("input_text"), F.col(output).alias("output_text")), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.text(path)


def write_json_documents(df: DataFrame, path: str, key: str) -> None:
    """JSON documents in a folder for each value of ``key``, and an index of the folders beside them."""
    df.write.mode("append").partitionBy(key).json(path)
    index = df.select(F.col(key).cast("string").alias("key")).distinct()
    index.select("key", F.concat(F.lit(f"{path}/{key}="), "key").alias("folder")).write.mode("append").json(f"{path}_index")


def read_json_documents(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The documents of the folders that the index names, each once; of all folders where there is no index."""
    if not _exists(spark, f"{path}_index"):
        return spark.read.schema(f"{schema}, {key} string").json(path)
    known = spark.read.schema("key string, folder string").json(f"{path}_index").select(F.col("key").alias(key)).distinct()
    return spark.read.schema(f"{schema}, {key} string").json(path).join(known, key, "left_semi")


def read_json_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document per file, with the stem of its file name as file_id."""
    r = spark.read.option("multiLine", True)
    df = (r.schema(schema) if schema else r).json(path)
    return df.withColumn("file_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (key, text), the key from the file's name."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("key"), F.col("value").alias("text"))


def write_together(tables: dict[str, DataFrame], folder: str, marker: str) -> None:
    """Several tables that become visible together, as one version: each goes to a folder of the version, which readers see
    once its marker is written, last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/{marker}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(marker,)], "marker string").coalesce(1).write.mode("append").json(f"{folder}/_committed")


def read_together(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of all committed versions; what a writer has not finished is not seen."""
    if not _exists(spark, f"{folder}/_committed"):
        return spark.createDataFrame([], schema)
    markers = sorted({r[0] for r in spark.read.schema("marker string").json(f"{folder}/_committed").collect()})  # one for each version
    return spark.read.schema(schema).parquet(*[f"{folder}/{name}/{m}" for m in markers])
