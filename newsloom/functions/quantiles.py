"""Exact quantiles of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import checkpointed


def exact(df: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(key, p0, p1, ...): the linearly interpolated quantiles of each group's values that are not null.

    Distinct values are counted before they move, ranged by group and value, and summed up range by range, so that no
    task sees all values of a group; only the values around each wanted rank are looked at again.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranged = checkpointed(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("k", "part").agg(F.sum("n").alias("s"))
    w = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(w), F.lit(0))).withColumn("total", F.sum("s").over(Window.partitionBy("k")))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("total") - 1) * s).alias("at")) for i, s in enumerate(shares)]))
    wanted = sums.select("k", "part", "before", "s", ranks.alias("r")).select("k", "part", "before", "s", "r.*")
    lower, upper = F.floor("at"), F.ceil("at")
    wanted = wanted.where((upper >= F.col("before")) & (lower < F.col("before") + F.col("s"))).select("k", "part", "before", "i", "at")
    inside = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # one range
    hit = ranged.join(wanted.select("k", "part", "before").distinct(), ["k", "part"])
    placed = hit.withColumn("lo", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    both = placed.join(wanted.select("k", "part", "i", "at"), ["k", "part"])
    holds = lambda r: (F.col("lo") <= r) & (F.col("lo") + F.col("n") > r)
    share = F.col("at") - F.floor("at")
    part = F.when(holds(F.floor("at")), F.col("v") * (1 - share)).otherwise(0.0) + F.when(holds(F.ceil("at")) & (share > 0), F.col("v") * share).otherwise(0.0)
    got = both.where(holds(F.floor("at")) | holds(F.ceil("at"))).groupBy("k", "i").agg(F.sum(part).alias("q"))
    return got.groupBy(F.col("k").alias(key)).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"p{i}") for i in range(len(shares))])
