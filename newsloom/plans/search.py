"""Queries on retrieval, pages, markets, streams and language tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.catalog import load
from newsloom.functions.text import STOPWORDS, jaccard, word_tokens
from newsloom.functions.vectors import dot, unit
from newsloom.operators import dedup, evaluation, language_tools, retrieval, topics, web
from newsloom.session import checkpointed, shared_path
from newsloom.streaming import news

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, folder, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("q_label"))
    return q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv"), "label")


_KNN = """
    with s as (select q.vec_id as query_id, d.vec_id as doc_id, q.label as q_label, d.label, list_cosine_similarity(q.embedding::double[], d.embedding::double[]) as similarity
               from embeddings q join embeddings d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id),
         r as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, doc_id) as rank from s)"""


def _ranked(spark: SparkSession, folder: str, k: int, **kw) -> DataFrame:
    q, d = _vectors(spark, folder)
    return retrieval.nearest(q, d, k, **kw)


@query(_KNN + " select query_id, doc_id, rank::int as rank, round(similarity, 6) as similarity from r where rank <= 10")
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder, 10).select("query_id", "doc_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(_KNN.replace("q.vec_id <> d.vec_id", "q.vec_id <> d.vec_id and d.label <= 4") + " select query_id, doc_id, rank::int as rank from r where rank <= 5")
def knn_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    q, d = _vectors(spark, folder)
    return retrieval.nearest(q, d.where("label <= 4"), 5).select("query_id", "doc_id", "rank")


@query(_KNN + ", c as (select *, row_number() over (partition by query_id, label order by round(similarity, 9) desc, doc_id) as n from r) select query_id, label, doc_id from c where n = 1")
def knn_per_class_exemplars(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of each class."""
    q, d = _vectors(spark, folder)
    return retrieval.nearest(q, d, 1, group="label").select("query_id", "label", "doc_id")


@query(_KNN + """, h as (select query_id, rank, (label = q_label)::int as hit from r where rank <= 3),
    n as (select q.vec_id as query_id, count(*) as n from embeddings q join embeddings d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id and q.label = d.label group by 1),
    a as (select k, h.query_id, sum(hit) as hits, sum(hit / log2(rank + 1)) as dcg, max(case when hit = 1 then 1.0 / rank else 0 end) as rr,
                 sum(hit * (select sum(g.hit) from h g where g.query_id = h.query_id and g.rank <= h.rank) / rank) as ap
          from h, (values (2), (3)) v(k) where rank <= k group by 1, 2)
    select a.k, round(avg((hits > 0)::int), 6) as accuracy, round(avg(hits / a.k), 6) as precision, round(avg(hits / n), 6) as recall,
           round(avg(dcg / list_sum(list_transform(range(1, least(n, a.k) + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg,
           round(avg(rr), 6) as mrr, round(avg(ap / least(n, a.k)), 6) as map from a join n using (query_id) group by a.k""")
def ir_metrics_at_k(spark: SparkSession, folder: str) -> DataFrame:
    r = _ranked(spark, folder, 3).select("query_id", "rank", (F.col("label") == F.col("q_label")).cast("int").alias("hit"))
    q, d = _vectors(spark, folder)
    n = q.join(d.groupBy("label").agg(F.count("*").alias("c")), F.col("q_label") == F.col("label")).select("query_id", (F.col("c") - 1).alias("n"))
    return evaluation.ranking_metrics(r, n)


@query("""
    select q.vec_id as query_id, d.label, round(avg(list_cosine_similarity(q.embedding::double[], d.embedding::double[])), 6) as similarity
    from embeddings q join embeddings d on q.vec_id % 50 = 0 group by 1, 2""")
def mean_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """The mean cosine of each class to each query: the query by the mean of the class's unit vectors, without pairs."""
    q, d = _vectors(spark, folder)
    mean = topics.mean_vectors(d.select("label", unit(F.col("dv")).alias("u")), "label", "u")
    pairs = q.crossJoin(F.broadcast(mean))  # ten classes
    return pairs.select("query_id", "label", F.round(dot(unit(F.col("qv")), F.col("mean")), 6).alias("similarity"))


_BM25 = """
    with d as (select id || '#' || row_number() over (partition by id order by title nulls first, body nulls first) as doc_id, title, body from (select distinct id, title, body from cleaned_articles)),
         f as (select doc_id, 'title' as field, title as text from d union all select doc_id, 'body', body from d),
         w as (select doc_id, field, regexp_extract_all(lower(text), '[a-z0-9]+') as t from f where text is not null),
         z as (select doc_id, field, len(t) as len, unnest(t) as term from w where len(t) > 0),
         tf as (select doc_id, field, len, term, count(*) as tf from z group by all),
         st as (select field, count(*) as n_docs, avg(len(t)) as avg_len from w where len(t) > 0 group by 1),
         df as (select field, term, count(*) as df from tf group by 1, 2),
         q as (select * from (select distinct arrival_no as query_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) as term from incoming_articles where arrival_no % 50 = 0)
               where term not in ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'from', 'has', 'have', 'he', 'her', 'his', 'if', 'in', 'into', 'is', 'it', 'its', 'no', 'not', 'of', 'on', 'or', 'our', 'she', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'we', 'were', 'which', 'will', 'with', 'you')),
         sc as (select query_id, doc_id, tf.field, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) as score
                from q join tf using (term) join df using (field, term) join st on st.field = tf.field group by 1, 2, 3)"""

_BM25_ALL = _BM25.replace(" where arrival_no % 50 = 0", "")  # every arrival asks


def _top(spark: SparkSession, folder: str, k: int, *names: str, asked: str = "true") -> DataFrame:
    """The best ``k`` articles in each field for the titles of the arrivals that ``asked`` names."""
    t = load(spark, folder, "cleaned_articles", "id", "title", "body").repartition("id")  # versions shuffles no more
    d = dedup.versions(t, "id", "title", "body", out="id")
    fields = F.inline(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("text")) for x in names]))
    docs = d.select(F.col("id").alias("doc_id"), fields).where("text is not null")
    q = load(spark, folder, "incoming_articles", "arrival_no", "title").where(asked).select(F.col("arrival_no").alias("query_id"), F.col("title").alias("text"))
    return retrieval.bm25_top(docs, q, k)


@query(_BM25 + """ select query_id, doc_id, rank::int as rank, round(score, 5) as score from (
    select *, row_number() over (partition by query_id order by round(score, 8) desc, doc_id) as rank from sc where field = 'body') where rank <= 10""")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, 10, "body", asked="arrival_no % 50 = 0").select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(_BM25_ALL + """, b as (select query_id, doc_id, max(score) as score from sc group by 1, 2)
    select query_id, doc_id, rank::int as rank from (select *, row_number() over (partition by query_id order by round(score, 8) desc, doc_id) as rank from b) where rank <= 10""")
def bm25_best_field(spark: SparkSession, folder: str) -> DataFrame:
    s = retrieval.best_field(_top(spark, folder, 10, "title", "body"))  # the ten best are among those of their best field
    return retrieval.ranked(s, ["query_id"], F.round("score", 8), ["doc_id"], 10).select("query_id", "doc_id", "rank")


@query(_BM25_ALL + """, t as (select *, row_number() over (partition by query_id, field order by round(score, 8) desc, doc_id) as rank from sc),
    u as (select query_id, doc_id, sum(1.0::double / (20 + rank)) as score from t where rank <= 50 group by 1, 2)
    select query_id, doc_id, round(score, 8) as score from (select *, row_number() over (partition by query_id order by round(score, 12) desc, doc_id) as n from u) where n <= 10""")
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Two ranked arms joined by reciprocal ranks."""
    arms = _top(spark, folder, 50, "title", "body")
    f = retrieval.fused(arms.select("query_id", "doc_id", "rank"))
    return retrieval.ranked(f, ["query_id"], F.round("score", 12), ["doc_id"], 10).select("query_id", "doc_id", F.round("score", 8).alias("score"))


@query()
def hybrid_retriever(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords by BM25 and all of the query by vectors of articles not older than two years before the last, fused, then made diverse."""
    t = load(spark, folder, "cleaned_articles", "id", "title", "body", "published")
    t = checkpointed(dedup.versions(t, "id", "title", "body", "published", out="doc_id"))
    fields = F.inline(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("text")) for x in ("title", "body")]))
    last = t.agg((F.max("published") - F.expr("interval 730 days")).alias("since"))
    recent = t.crossJoin(F.broadcast(last)).where("published > since").select("doc_id", F.concat_ws(" ", "body", "title").alias("text"))  # one row
    q = load(spark, folder, "incoming_articles", "arrival_no", "title").where("arrival_no % 50 = 0").select(F.col("arrival_no").alias("query_id"), F.col("title").alias("text"))
    return retrieval.hybrid(q.where("text is not null"), recent, t.select("doc_id", fields).where("text is not null"))


_FUSION = _KNN + """, l as (select query_id // 250 as fusion_id, query_id // 50 % 5 as list_no, doc_id, rank from r where rank <= 20),
    w as (select distinct fusion_id, list_no, case when list_no = 0 then 2.0::double else 1.0::double end as w from l),
    c as (select distinct fusion_id, doc_id from l),
    f as (select c.fusion_id, c.doc_id, sum(w.w / (60 + coalesce(l.rank, 100))) as score from c join w using (fusion_id) left join l on l.fusion_id = c.fusion_id and l.list_no = w.list_no and l.doc_id = c.doc_id group by 1, 2)
    select fusion_id, doc_id, rank::int as rank from (select *, row_number() over (partition by fusion_id order by round(score, 12) {order}, doc_id) as rank from f) where rank <= 7"""


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    r = _ranked(spark, folder, 20)
    return r.select(F.floor(F.col("query_id") / 250).alias("fusion_id"), (F.floor(F.col("query_id") / 50) % 5).alias("list_no"), "doc_id", "rank")


@query(_FUSION.format(order="desc"))
def rag_fusion_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rag_fusion(_lists(spark, folder)).select("fusion_id", "doc_id", "rank")


@query(_FUSION.format(order="asc"))
def rag_fusion_worst_first(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rag_fusion(_lists(spark, folder), worst_first=True).select("fusion_id", "doc_id", "rank")


@query()
def mmr_rerank(spark: SparkSession, folder: str) -> DataFrame:
    q, d = _vectors(spark, folder)
    near = _ranked(spark, folder, 50).select("query_id", "doc_id")
    return retrieval.mmr(near.join(q.select("query_id", "qv"), "query_id").join(d.select("doc_id", "dv"), "doc_id").select("query_id", "doc_id", "qv", "dv"))


@query("""
    with w as (select qa_id, list_filter(regexp_extract_all(lower(coalesce(answerable, '') || '. ' || coalesce(answer, '')), '[a-z0-9]+'), lambda x: x not in ({s})) as a,
                      list_filter(regexp_extract_all(lower(coalesce(context, '')), '[a-z0-9]+'), lambda x: x not in ({s})) as b from augmented_qa),
         j as (select qa_id, len(list_intersect(a, b)) as i, len(list_distinct(a || b)) as u from w)
    select qa_id, round(coalesce(i / nullif(u, 0), 0), 6) as similarity from j where coalesce(i / nullif(u, 0), 0) >= 0.03""".format(s="'a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'from', 'has', 'have', 'he', 'her', 'his', 'if', 'in', 'into', 'is', 'it', 'its', 'no', 'not', 'of', 'on', 'or', 'our', 'she', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'we', 'were', 'which', 'will', 'with', 'you'"))
def relevance_gate(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "answerable", "answer", "context")
    words = lambda c: F.filter(word_tokens(c), lambda w: ~w.isin(*STOPWORDS))
    asked = F.concat(F.coalesce("answerable", F.lit("")), F.lit(". "), F.coalesce("answer", F.lit("")))
    j = t.select("qa_id", jaccard(words(asked), words(F.coalesce("context", F.lit("")))).alias("similarity"))
    return j.where("similarity >= 0.03").select("qa_id", F.round("similarity", 6).alias("similarity"))


_LINKS = """
    with l as (select distinct id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as root, regexp_extract(url, '^([a-z]+:)', 1) as scheme,
                      unnest(regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)) as y from scraped_articles where html is not null and url is not null),
         b as (select *, trim(y, '"''') as x from l),
         n as (select distinct id, regexp_replace(case when starts_with(x, '//') then scheme || x when starts_with(x, '/') then root || x
                                                       when starts_with(x, '#') then split_part(url, '#', 1) || x else x end, '[#/]$', '') as link from b)"""


@query(_LINKS + " select id, count(*) as n_links from n where link <> '' group by 1")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", "id", "url", "html").where("html is not null and url is not null")
    each = t.select("id", F.explode(web.links(F.col("html"), F.col("url"))).alias("link")).distinct()
    return each.groupBy("id").agg(F.count("*").alias("n_links"))


@query(_LINKS + " select distinct link from n where link <> '' and link not in (select url from scraped_articles where url is not null)")
def frontier_new_links(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", "url", "html")
    seen = t.where("url is not null").select(F.col("url").alias("link")).distinct()
    return web.frontier(t.where("html is not null and url is not null"), seen)


@query("""
    with p as (select distinct url as link, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, regexp_replace(url, '^[a-z]+://[^/?#]*', '') as path from scraped_articles where url is not null)
    select link from p where not (host like 'www.t%' and starts_with(path, '/2023/')) or (host like 'www.t%' and starts_with(path, '/2023/01/'))""")
def robots_permitted(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that rules by host and prefix permit: one year of some sites is closed, but for its first month."""
    t = load(spark, folder, "scraped_articles", "url").where("url is not null").select(F.col("url").alias("link")).distinct()
    hosts = t.select(F.lower(F.regexp_extract("link", r"^[a-z]+://([^/?#:]+)", 1)).alias("host")).where("host like 'www.t%'").distinct()
    rules = hosts.select("host", F.inline(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(a).alias("allow")) for p, a in (("/2023/", False), ("/2023/01/", True))])))
    return web.permitted(t, rules)


@query("""
    with h as (select id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as headline,
                      nullif(regexp_extract(html, '<meta name="article:published_time" content="([^"]*)"', 1), '') as stamp from scraped_articles where html is not null)
    select * from h where headline <> ''""")
def html_article_extract(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", "id", "html").where("html is not null")
    return web.NEWS.extract(t).select("id", "headline", "stamp")


@query("""
    select event_type, (epoch_us(ts) // 86400000000)::int as day, arg_min(value, (epoch_us(ts), event_id)) as open, max(value) as high, min(value) as low,
           arg_max(value, (epoch_us(ts), event_id)) as close, count(*) as n from events group by 1, 2""")
def ohlc_bars(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "events", "event_id", "event_type", "ts", "value")
    at = F.struct("ts", "event_id")
    return t.groupBy("event_type", F.unix_date(F.to_date("ts")).alias("day")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n")
    )


@query("""
    select event_id, 'k' as key, json_extract_string(props, '$.k') as value, 'Count' as label from events where json_extract_string(props, '$.k') is not null""")
def json_kpi_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of a JSON object as rows with their display label; a nested object counts by its raw value."""
    t = load(spark, folder, "events", "event_id", "props")
    each = t.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    raw = F.coalesce(F.get_json_object("value", "$.raw"), F.col("value"))
    labels = spark.createDataFrame([("k", "Count"), ("price", "Price")], "key string, label string")
    return each.join(labels, "key").select("event_id", "key", raw.alias("value"), "label").where("value is not null")


@query("select distinct url from incoming_articles where url is not null")
def stream_url_dedup(spark: SparkSession, folder: str) -> DataFrame:
    s = news.file_stream(spark, f"{folder}/incoming_articles.parquet").where("url is not null").select("url")
    return news.run_to(news.unseen_urls(s), shared_path(spark, "urls"))


@query("select (epoch_us(date_trunc('hour', ts)) // 1000000)::bigint as start_s, event_type, count(*) as n from events group by 1, 2")
def stream_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = news.file_stream(spark, f"{folder}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = shared_path(spark, "windows")
    news.each_batch(news.windowed_counts(s, "ts", "event_type"), lambda b, _: b.write.mode("overwrite").parquet(out), mode="complete")
    return spark.read.parquet(out).select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


@query()
def cluster_topics(spark: SparkSession, folder: str) -> DataFrame:
    return topics.cluster(load(spark, folder, "embeddings"), "vec_id", "embedding")


@query()
def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "body").where("body is not null").distinct()
    return language_tools.chunked(t, "id", "body").select("id", "chunk_no", F.size(F.split("chunk", " ")).alias("words"), F.size("entities").alias("entities"))


@query()
def hypergraph_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "body").where("body is not null").distinct()
    return language_tools.extractive_summary(t, "id", "body")


@query("""
    select qa_id, array_to_string(string_split(regexp_replace(regexp_replace(regexp_replace(context, '^\\s+', ''), '\\s+$', ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ') as predicted
    from augmented_qa where context is not null union all select qa_id, '' from augmented_qa where context is null""")
def batch_generation(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "context")
    return language_tools.generated(t, "context", "predicted").select("qa_id", "predicted")


@query("""
    with recursive t as (select batch_no, source, url, title, row_number() over (partition by batch_no, source order by arrival_no) as k
                         from incoming_articles where source is not null and url is not null and title is not null),
         s(batch_no, source, k, urls, titles) as (
             select batch_no, source, 0::bigint, []::varchar[], []::varchar[] from t where k = 1
             union all
             select batch_no, source, tk, case when f then list_append(urls, url) else urls end, case when f then list_append(titles, title) else titles end
             from (select s.batch_no, s.source, s.urls, s.titles, t.url, t.title, t.k as tk, not list_contains(s.urls, t.url) and not list_contains(s.titles, t.title) as f
                   from s join t on t.batch_no = s.batch_no and t.source = s.source and t.k = s.k + 1))
    select batch_no, source, max(len(urls)) as n from s group by 1, 2""")
def sources_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch and source, how many arrivals have both an address and a title that are new among those kept."""
    t = load(spark, folder, "incoming_articles", "batch_no", "source", "arrival_no", "url", "title").where("source is not null and url is not null and title is not null")
    kept = language_tools.first_of_both(t, ["batch_no", "source"], "arrival_no", "url", "title")
    return kept.groupBy("batch_no", "source").agg(F.count("*").alias("n"))
