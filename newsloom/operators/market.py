"""Key figures and price bars of companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key figures by group with their labels.
GROUPS = {
    "Basic": {"marketCap": "Market Cap($)", "enterpriseValue": "Total Enterprise Value (TEV)($)", "totalRevenue": "Total Revenues($)"},
    "Profitability": {
        "grossMargins": "Gross Profit Margin(%)", "ebitdaMargins": "EBITDA Margin(%)", "operatingMargin": "Operating Margin(%)", "netProfitMargin": "Net Profit Margin(%)",
        "profitMargins": "Pre-Tax Profit Margin(%)", "enterpriseToRevenue": "EV/Sales", "enterpriseToEbitda": "EV/EBITDA",
    },
    "Shares": {"revenuePerShare": "Revenue per Share($)", "trailingEps": "EPS Diluted($)", "trailingPE": "P/E", "priceToBook": "P/B"},
}
# How wide the bars of a period are, and how long it is.
INTERVALS = {"1d": "30 minutes", "5d": "1 hour", "1mo": "1 day", "3mo": "1 day", "6mo": "1 day"}
DAYS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 180}


def figures(info: DataFrame, id: str, json: str, modules: list[str]) -> DataFrame:
    """(id, key, value) of JSON objects of modules of figures: an object counts by its raw value, one without a raw value
    not at all, a plain value as it is, and of the same key in several modules the last in the order of ``modules``."""
    each = info.select(F.col(id).alias("id"), F.explode(F.from_json(json, "map<string,map<string,string>>")).alias("module", "held"))
    order = F.array_position(F.array(*[F.lit(m) for m in modules]), F.col("module"))
    flat = each.select("id", order.alias("at"), F.explode("held").alias("key", "value"))
    nested = F.col("value").startswith("{")
    flat = flat.withColumn("value", F.when(nested, F.get_json_object("value", "$.raw")).otherwise(F.col("value"))).where(~nested | F.col("value").isNotNull())
    return flat.groupBy("id", "key").agg(F.max_by("value", "at").alias("value"))


def labelled(value: Column) -> Column:
    """A figure as shown: nothing and zero are N/A."""
    return F.when(value.isNull() | (value == "") | (value.try_cast("double") == 0), "N/A").otherwise(value)


def grouped(held: DataFrame) -> DataFrame:
    """(id, title, key, label, value): the figures of the groups that a company has."""
    spark = held.sparkSession
    table = spark.createDataFrame([(g, k, name) for g, keys in GROUPS.items() for k, name in keys.items()], "title string, key string, label string")
    return held.join(F.broadcast(table), "key").select("id", "title", "key", "label", labelled(F.col("value")).alias("value"))  # fourteen rows


def with_capital(held: DataFrame) -> DataFrame:
    """Figures of companies with a market capital that is not nothing or zero."""
    sure = held.where("key = 'marketCap'").where(labelled(F.col("value")) != "N/A").select("id")
    return held.join(sure, "id", "left_semi")


def bars(ticks: DataFrame, key: str, time: str, value: str, tie: str, period: str, now: Column) -> DataFrame:
    """(key, start, open, high, low, close, n): bars of a period up to ``now``, as wide as the period asks."""
    since = now - F.expr(f"interval {DAYS[period]} days")
    t = ticks.where((F.col(time) > since) & (F.col(time) <= now))
    at = F.struct(time, tie)
    return t.groupBy(key, F.window(time, INTERVALS[period])["start"].alias("start")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("n")
    )


def screener(names: DataFrame, held: DataFrame, last: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, id, close, title, label, value): of the companies that a query names (query_id, id), at most ``most`` with figures
    and bars, in the order of their ids."""
    from pyspark.sql import Window

    sure = with_capital(held)
    known = names.distinct().join(sure.select("id").distinct(), "id", "left_semi").join(last, "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return known.withColumn("rank", rank).where(F.col("rank") <= most).join(grouped(sure), "id").select("query_id", "id", "close", "title", "label", "value")
