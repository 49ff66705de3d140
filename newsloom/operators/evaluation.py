"""Evaluation metrics as aggregates."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.stage import staged
from newsloom.functions.text import word_tokens


def classification_report(df: DataFrame, truth: Column, predicted: Column, digits: int = 6) -> DataFrame:
    """(label, precision, recall, f1, support) of two boolean columns; null counts as false."""
    y, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    n = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    each = F.inline(F.array(
        F.struct(F.lit(True).alias("label"), F.col("tp").alias("t"), F.col("fp").alias("f"), F.col("fn").alias("m")),
        F.struct(F.lit(False).alias("label"), F.col("tn").alias("t"), F.col("fn").alias("f"), F.col("fp").alias("m")),
    ))
    precision = F.coalesce(F.try_divide("t", F.col("t") + F.col("f")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("t", F.col("t") + F.col("m")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    r = lambda c: F.round(c, digits)
    return n.select(each).select("label", r(precision).alias("precision"), r(recall).alias("recall"), r(f1).alias("f1"), (F.col("t") + F.col("m")).alias("support"))


def rouge_n(df: DataFrame, id: str, label: str, predicted: str, n: int = 1) -> DataFrame:
    """(id, precision, recall, f1) of n-gram overlap with clipped counts."""

    def grams(c: str) -> DataFrame:
        cut = staged(df.select(F.col(id).alias("id"), F.col(c).alias("c")), ["id"], {"t": word_tokens(F.col("c"))})
        t = F.col("t")
        g = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
        some = cut.select("id", F.explode(F.when(F.size(t) >= n, g).otherwise(F.array().cast("array<string>"))).alias("g"))
        return some.groupBy("id", "g").agg(F.count("*").alias("n"))

    a, b = grams(label), grams(predicted)
    total = lambda x, name: x.groupBy("id").agg(F.sum("n").alias(name))
    common = a.join(b.withColumnRenamed("n", "m"), ["id", "g"]).groupBy("id").agg(F.sum(F.least("n", "m")).alias("common"))
    rows = df.select(F.col(id).alias("id")).distinct().join(common, "id", "left").join(total(a, "of_label"), "id", "left").join(total(b, "of_predicted"), "id", "left")
    c = F.coalesce("common", F.lit(0))
    p, r = F.coalesce(F.try_divide(c, F.col("of_predicted")), F.lit(0.0)), F.coalesce(F.try_divide(c, F.col("of_label")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.select("id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, all of ``a`` at a time as the bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for y in b:
        hit = open_ & places.get(y, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(a) - open_.bit_count()


def rouge_l(df: DataFrame, id: str, label: str, predicted: str) -> DataFrame:
    """(id, precision, recall, f1) by the longest common subsequence of words."""
    t = df.select(F.col(id).alias("id"), word_tokens(F.coalesce(F.col(label), F.lit(""))).alias("a"), word_tokens(F.coalesce(F.col(predicted), F.lit(""))).alias("b"))

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_common(list(x), list(y)) for x, y in zip(a, b)])

    t = t.withColumn("c", common("a", "b"))
    p, r = F.coalesce(F.try_divide("c", F.size("b")), F.lit(0.0)), F.coalesce(F.try_divide("c", F.size("a")), F.lit(0.0))
    return t.select("id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def union_of_common(sentence: list[str], others: list[list[str]]) -> set[int]:
    """Places of a sentence's words that lie in its longest common subsequence with any of the others."""
    out: set[int] = set()
    for b in others:
        rows = [[0] * (len(b) + 1)]
        for x in sentence:
            last, row = rows[-1], [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
            rows.append(row)
        i, j = len(sentence), len(b)
        while i and j:
            if sentence[i - 1] == b[j - 1]:
                out.add(i - 1)
                i, j = i - 1, j - 1
            elif rows[i - 1][j] >= rows[i][j - 1]:
                i -= 1
            else:
                j -= 1
    return out


def rouge_lsum(df: DataFrame, id: str, label: str, predicted: str) -> DataFrame:
    """(id, precision, recall, f1) by lines: the words of each line of the label in a longest common subsequence with any
    line of the prediction, each word as often as both have it."""

    @F.pandas_udf("struct<c:int,a:int,b:int>")
    def common(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            mine, theirs = ([re.findall("[a-z0-9]+", line) for line in (t or "").lower().split("\n")] for t in (x, y))
            have, said = (Counter(w for line in t for w in line) for t in (mine, theirs))
            size, other, hits = have.total(), said.total(), 0
            for line in mine:
                for i in sorted(union_of_common(line, theirs)):
                    if have[line[i]] > 0 and said[line[i]] > 0:
                        hits += 1
                        have[line[i]] -= 1
                        said[line[i]] -= 1
            rows.append((hits, size, other))
        return pd.DataFrame(rows, columns=["c", "a", "b"])

    t = df.select(F.col(id).alias("id"), common(F.col(label), F.col(predicted)).alias("x")).select("id", "x.*")
    p, r = F.coalesce(F.try_divide("c", "b"), F.lit(0.0)), F.coalesce(F.try_divide("c", "a"), F.lit(0.0))
    return t.select("id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def ranking_metrics(ranked: DataFrame, n_relevant: DataFrame, ks: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(k, accuracy, precision, recall, ndcg, mrr, map) of (query_id, rank, hit), means over the queries of
    ``n_relevant`` (query_id, n)."""
    out = None
    for k in ks:
        top = ranked.where(F.col("rank") <= k)
        before = top.alias("x").join(top.alias("y"), (F.col("x.query_id") == F.col("y.query_id")) & (F.col("y.rank") <= F.col("x.rank")))
        at = before.groupBy(F.col("x.query_id").alias("query_id"), F.col("x.rank").alias("rank"), F.col("x.hit").alias("hit")).agg(F.sum(F.col("y.hit")).alias("so_far"))
        q = at.groupBy("query_id").agg(
            F.sum("hit").alias("hits"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"),
            F.max(F.when(F.col("hit") == 1, 1 / F.col("rank")).otherwise(0.0)).alias("rr"), F.sum(F.col("hit") * F.col("so_far") / F.col("rank")).alias("ap"),
        )
        q = n_relevant.where("n > 0").join(q, "query_id", "left").na.fill(0)
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        m = q.agg(
            F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.col("hits") / k), 6).alias("precision"),
            F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"),
            F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.col("ap") / F.least(F.col("n"), F.lit(k))), 6).alias("map"),
        ).select(F.lit(k).alias("k"), "*")
        out = m if out is None else out.unionByName(m)
    return out
