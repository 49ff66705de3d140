"""Streams: pages and events, deduplicated, windowed, appended.

Every stream here runs with ``availableNow``: it processes what has come since its checkpoint and stops, so that
a scheduler can run it as often as wanted. State and checkpoints live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import shared_path


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files at ``path``, now and later; ``path`` is a folder or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def run_to(stream: DataFrame, path: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream until nothing is left and read what it wrote."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint or shared_path(spark, "stream")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> None:
    """Hand every micro-batch to ``write``; batches come again under the same number after a failure."""
    q = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or shared_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    q.awaitTermination()


def unseen_urls(stream: DataFrame, url: str = "url") -> DataFrame:
    """The first of every address, for as long as the stream lives."""
    return stream.dropDuplicates([url])


def unseen_urls_within(stream: DataFrame, time: str, delay: str = "1 day", url: str = "url") -> DataFrame:
    """The first of every address within ``delay``, after which its state is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "5 days") -> DataFrame:
    """(start, key, n): counts per window, given out in append mode once the window is over; rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def crawl_slices(step: Callable[[DataFrame | None], DataFrame], seconds: float, reset_after: float, until: Callable[[], bool], clock: Callable[[], float]) -> int:
    """Endless work in slices: ``step`` takes what is known (None at first and after each reset) and gives it back; it is called
    until ``until`` says so, at most once in ``seconds``, and what is known is forgotten after ``reset_after``. Returns the number of calls."""
    import time

    known, begun, n = None, clock(), 0
    while not until():
        at = clock()
        if at - begun >= reset_after:
            known, begun = None, at
        known = step(known)
        n += 1
        time.sleep(max(0.0, seconds - (clock() - at)))
    return n
