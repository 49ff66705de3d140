"""Topic models in tables: the model to use, assignments, recency, summaries, term weights, clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from newsloom.functions.text import STOPWORDS
from newsloom.operators.language_tools import chunked, hashing_encoder

PROBABILITY = 0.51


def latest_model(models: DataFrame, servable: bool = False, since: Column | None = None) -> DataFrame:
    """The newest model: of all, of the servable ones, or of those fitted since an instant."""
    rows = models.where("servable") if servable else models
    rows = rows.where(F.col("fit_date") >= since) if since is not None else rows
    return rows.orderBy(F.desc("fit_date"), "id").limit(1)


def without_topic(articles: DataFrame, assigned: DataFrame, model: str) -> DataFrame:
    """Articles that a model has given no topic."""
    return articles.join(assigned.where(F.col("model") == model), articles["id"] == F.col("article_id"), "left_anti")


def recency(assigned: DataFrame, articles: DataFrame, summaries: DataFrame, model: DataFrame, least: float = PROBABILITY) -> DataFrame:
    """(model, topic, recency_s, summary) of one model's topics: the mean second of publication, rounded, over
    the assignments of at least this probability. ``model`` has one row."""
    chosen = model.select(F.col("id").alias("model"))
    sure = assigned.where(F.col("topic_prob") >= least).join(F.broadcast(chosen), "model")
    dated = sure.join(articles.select(F.col("id").alias("article_id"), "published"), "article_id")
    mean = dated.groupBy("model", "topic").agg(F.round(F.avg(F.unix_seconds("published"))).cast("long").alias("recency_s"))
    return mean.join(summaries, ["model", "topic"]).select("model", "topic", "recency_s", "summary")


def with_summary(assigned: DataFrame, summaries: DataFrame) -> DataFrame:
    """Assignments with their topic's summary, empty where there is none."""
    s = summaries.select("model", "topic", F.col("summary").alias("topic_text"))
    return assigned.join(s, ["model", "topic"], "left").withColumn("topic_text", F.coalesce("topic_text", F.lit("")))


def packed_titles(titles: DataFrame, budget: int = 512) -> DataFrame:
    """(topic, n_titles, n_tokens, text): titles by descending probability, while what came before is within
    the budget of tokens between blanks; the last may exceed it. A line has two tokens or more, so that more than half the
    budget of titles is never needed: those are kept before titles are added up."""
    line = F.concat(F.lit("Title: "), "title")
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("prob"), "id"))
    sized = titles.withColumn("line", line).withColumn("rank", rank).where(F.col("rank") <= budget // 2 + 1).withColumn("n", F.size(F.split("line", " ")))
    w = Window.partitionBy("topic").orderBy(F.desc("prob"), "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    kept = sized.withColumn("before", before).where(F.col("before") <= budget)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), "id", "line")))
    return kept.groupBy("topic").agg(F.count("*").alias("n_titles"), F.sum("n").alias("n_tokens"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def class_term_weights(words: DataFrame) -> DataFrame:
    """(cls, term, weight) of rows (cls, term): frequency within the class by ln(1 + A / frequency over all), A
    the mean number of words of a class. Stop words are left out."""
    w = words.where(~F.col("term").isin(*STOPWORDS))
    tf = w.groupBy("cls", "term").agg(F.count("*").alias("n"))
    of_class = tf.groupBy("cls").agg(F.sum("n").alias("all"))
    of_term = tf.groupBy("term").agg(F.sum("n").alias("f"))
    mean = of_class.agg(F.avg("all").alias("mean"))
    joined = tf.join(of_class, "cls").join(of_term, "term").crossJoin(F.broadcast(mean))  # one row
    return joined.select("cls", "term", (F.col("n") / F.col("all") * F.log(1 + F.col("mean") / F.col("f"))).alias("weight"))


def mean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean) element by element, in order."""
    each = vectors.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("i", "x")))  # as long as a vector
    return each.groupBy(key).agg(F.transform(rows, lambda r: r["x"]).alias("mean"))


def with_default_vector(keys: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of all ``keys``: their own vector, or the mean of all where they have none."""
    every = vectors.select(F.lit(0).alias("g"), vector)
    mean = mean_vectors(every, "g", vector).select(F.col("mean").alias("__mean"))
    joined = keys.join(vectors, key, "left").join(F.broadcast(mean), F.lit(True), "left")  # one vector
    return joined.select(key, F.coalesce(vector, "__mean").alias(vector))


@F.pandas_udf(ArrayType(DoubleType()))
def encoded(s: pd.Series) -> pd.Series:
    return pd.Series(hashing_encoder(s.fillna("").tolist()), dtype=object)


def index_documents(assigned: DataFrame, articles: DataFrame, summaries: DataFrame, least: float = PROBABILITY) -> DataFrame:
    """(key, model, topic, description, vector, recency_s) of the topics of all models that have a summary and articles."""
    sure = assigned.where(F.col("topic_prob") >= least).join(articles.select(F.col("id").alias("article_id"), "published"), "article_id")
    mean = sure.groupBy("model", "topic").agg(F.round(F.avg(F.unix_seconds("published"))).cast("long").alias("recency_s"))
    rows = summaries.where("summary is not null").join(mean, ["model", "topic"])
    return rows.select(F.concat_ws("-", "model", F.col("topic").cast("string")).alias("key"), "model", "topic", F.trim("summary").alias("description"), encoded(F.col("summary")).alias("vector"), "recency_s")


def chunk_documents(articles: DataFrame, summaries: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, chunk, vector, entities, topic, topic_text, topic_vector, title, url, published_day) of articles (id, title, url,
    published, body, topic): a topic without a summary has an empty text and the mean of all topics' vectors."""
    cut = chunked(articles, "id", "body", size, overlap)
    told = summaries.where("summary is not null").select("topic", F.col("summary").alias("topic_text"), encoded(F.col("summary")).alias("mean"))
    wanted = articles.select("topic").distinct()
    vectors = with_default_vector(wanted, told.select("topic", "mean"), "topic", "mean").join(told.select("topic", "topic_text"), "topic", "left")
    facts = articles.select("id", "title", "url", "published", "topic").withColumn("t", F.coalesce("topic", F.lit(-2**31)))
    known = facts.join(vectors.withColumn("t", F.coalesce("topic", F.lit(-2**31))).drop("topic"), "t", "left").drop("t")
    return cut.join(known, "id").select(
        F.concat_ws("-", "id", F.col("chunk_no").cast("string")).alias("key"), "chunk", encoded(F.col("chunk")).alias("vector"), F.array_join("entities", " ").alias("entities"),
        "topic", F.coalesce("topic_text", F.lit("")).alias("topic_text"), F.col("mean").alias("topic_vector"), "title", "url", F.unix_date(F.to_date("published")).alias("published_day"),
    )


class TopicModel:
    """Principal components and the centres of clusters on them, with each cluster's mean distance: what assigns rows never
    seen. Saved as one small table."""

    def __init__(self, reduce: np.ndarray, centres: np.ndarray, spread: np.ndarray):
        self.reduce, self.centres, self.spread = reduce, centres, spread

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession

        rows = [(n, i, [float(x) for x in r]) for n in ("reduce", "centres", "spread") for i, r in enumerate(np.atleast_2d(getattr(self, n)))]
        SparkSession.active().createDataFrame(rows, "part string, i int, x array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> TopicModel:
        rows = sorted(spark.read.parquet(path).collect())  # as large as a model
        part = lambda n: np.array([r["x"] for r in rows if r["part"] == n])
        return cls(part("reduce"), part("centres"), part("spread")[0])

    def assign(self, vectors: DataFrame, id: str, vector: str) -> DataFrame:
        """(id, topic, topic_prob): the nearest centre and how sure it is; -1 for vectors farther than three times the mean, of
        clusters that are none, and null vectors."""
        shared = vectors.sparkSession.sparkContext.broadcast((self.reduce, self.centres, self.spread))  # a model

        def run(batches):
            reduce, centres, spread = shared.value
            for b in batches:
                some = b["v"].notna().to_numpy()
                topic, prob = np.full(len(b), -1), np.zeros(len(b))
                if some.any():
                    x = np.stack(b["v"][some].to_numpy()).astype(float) @ reduce
                    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
                    at = d.argmin(1)
                    near, mean = d[np.arange(len(at)), at], spread[at]
                    topic[some] = np.where((near > 3 * mean) | (mean < 0), -1, at)
                    prob[some] = np.where(mean < 0, 0.0, np.round(mean / (mean + near + 1e-12), 9))
                if len(b):
                    yield pd.DataFrame({"id": b["id"], "topic": topic, "topic_prob": prob})

        kind = vectors.schema[id].dataType.simpleString()
        return vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, f"id {kind}, topic int, topic_prob double")


def fit(vectors: DataFrame, vector: str, k: int = 10, components: int = 16, least: int = 5, seed: int = 7) -> TopicModel:
    """A model fitted by principal components and bisecting k-means, both distributed; what comes back has a fixed size."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    pca = PCA(k=components, inputCol="v", outputCol="r").fit(rows)
    reduced = pca.transform(rows)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="r", predictionCol="topic").fit(reduced)
    centres = np.array([[float(x) for x in c] for c in model.clusterCenters()])
    table = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "topic int, c array<double>")
    put = model.transform(reduced).join(F.broadcast(table), "topic")  # k rows
    d = F.sqrt(F.aggregate(F.zip_with(vector_to_array("r"), "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    spread = np.full(len(centres), -1.0)
    for r in put.groupBy("topic").agg(F.count("*").alias("n"), F.avg(d).alias("mean")).collect():  # k rows
        spread[r["topic"]] = r["mean"] if r["n"] >= least else -1.0
    return TopicModel(pca.pc.toArray(), centres, spread)


def cluster(vectors: DataFrame, id: str, vector: str, k: int = 10, components: int = 16, least: int = 5, seed: int = 7) -> DataFrame:
    """(id, topic, topic_prob): fitted and assigned. Clusters under ``least`` members, and vectors farther from their centre
    than three times the mean, are outliers (-1)."""
    return fit(vectors, vector, k, components, least, seed).assign(vectors, id, vector)
