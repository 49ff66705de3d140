"""Calls of pluggable language models over rows: retries, failures as values, prompts with examples, a curation chain."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def waits(tries: int, start: float = 1.0, factor: float = 2.0, noise: float = 0.2, seed: int | None = None) -> list[float]:
    """Seconds before each further try: growing by ``factor``, each up to ``noise`` more or less."""
    rng = random.Random(seed)
    return [start * factor**i * (1 + noise * (2 * rng.random() - 1)) for i in range(tries)]


def retried(call: Callable, *args, tries: int = 6, exceptions: tuple = (Exception,), sleep: Callable[[float], None] = time.sleep, **timing):
    """``call`` until it succeeds, waiting longer each time; after ``tries`` more the last failure is raised."""
    for pause in waits(tries, **timing):
        try:
            return call(*args)
        except exceptions:
            sleep(pause)
    return call(*args)


def answered(df: DataFrame, prompt: Column, out: str, model: Callable[[str], str], tries: int = 0) -> DataFrame:
    """``df`` with ``out``, a struct of value and error; a row never fails the others, and null asks nothing."""

    @F.pandas_udf("struct<value:string,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((None if x is None else retried(model, x, tries=tries), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    return df.withColumn(out, run(prompt))


def succeeded(df: DataFrame, out: str) -> DataFrame:
    """Rows that did not fail, with the value alone."""
    return df.where(F.col(out)["error"].isNull()).withColumn(out, F.col(out)["value"])


def few_shot(examples: Column, task: Column, most: int) -> Column:
    """A prompt of as many examples as stay within ``most`` tokens between blanks together with the task; the first come first."""
    size = lambda c: F.size(F.split(c, " "))
    empty = F.struct(size(task).alias("n"), F.array().cast("array<string>").alias("kept"))
    held = F.aggregate(
        examples, empty,
        lambda a, x: F.when(a["n"] + size(x) <= most, F.struct((a["n"] + size(x)).alias("n"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a),
    )
    return F.array_join(F.concat(held["kept"], F.array(task)), "\n\n")


def curated(df: DataFrame, id: str, summary: str, relevant: Callable[[str], str], rewrite: Callable[[str], str], headline: Callable[[str], str], ask: Callable[[str], str]) -> DataFrame:
    """(id, summary, question): relevant summaries rewritten, with a headline before them and a question about them. A model says
    yes or no to relevance; what fails at any step is left out."""
    rows = succeeded(answered(df.select(F.col(id).alias("id"), F.col(summary).alias("text")), F.col("text"), "relevant", relevant), "relevant")
    rows = rows.where(F.lower("relevant").startswith("yes"))
    rows = succeeded(answered(rows, F.col("text"), "told", rewrite), "told")
    rows = succeeded(answered(rows, F.col("told"), "head", headline), "head")
    rows = rows.withColumn("summary", F.concat(F.trim("head"), F.lit("\n"), F.trim("told")))
    return succeeded(answered(rows, F.col("summary"), "question", ask), "question").select("id", "summary", "question")
