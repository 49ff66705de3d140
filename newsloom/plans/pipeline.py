"""Queries on coreference, curation with models, topics of unseen rows, index documents, markets and salted signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.catalog import load
from newsloom.operators import coref, dedup, generation, language_tools, market, retrieval, topics
from newsloom.session import shared_path

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "cleaned_articles", "id", "body").where("body is not null").distinct()


@query()
def coref_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with pronouns rewritten as what they mention; those that cannot be are left out."""
    return coref.resolved(_bodies(spark, folder), "id", "body")


@query()
def coref_by_window(spark: SparkSession, folder: str) -> DataFrame:
    """The same, sentence by sentence in the light of the five before."""
    return coref.resolved(_bodies(spark, folder), "id", "body", coref.rewritten_by_window)


@query("""
    with s as (select distinct id, summary from cleaned_articles where summary is not null and contains(summary, 'percent')),
         r as (select id, replace(summary, ' on Monday', ' that day') as t from s),
         h as (select id, trim(regexp_extract(t, '^([^.!?\\n]{0,40})', 1)) || chr(10) || trim(t) as summary from r)
    select id, summary, 'What is said about ' || lower(split_part(summary, ' ', 1)) || '?' as question from h""")
def curation_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant summaries, rewritten, with a headline and a question, by models that are plain rules here."""
    import re

    t = load(spark, folder, "cleaned_articles", "id", "summary").where("summary is not null").distinct()
    return generation.curated(
        t, "id", "summary", lambda s: "Yes." if "percent" in s else "No.", lambda s: s.replace(" on Monday", " that day"),
        lambda s: re.match(r"[^.!?\n]{0,40}", s)[0], lambda s: f"What is said about {s.split(' ')[0].lower()}?",
    )


@query("""
    select qa_id, try_cast(answer as double) as value, case when try_cast(answer as double) is null then 'failed' else 'done' end as state
    from augmented_qa where answer is not null and regexp_matches(answer, '^[0-9.]+$|^[A-Za-z]')""")
def failed_calls(spark: SparkSession, folder: str) -> DataFrame:
    """A call that fails for a row is a value of that row."""
    t = load(spark, folder, "augmented_qa", "qa_id", "answer").where(F.col("answer").rlike("^[0-9.]+$|^[A-Za-z]"))
    done = generation.answered(t, F.col("answer"), "x", lambda s: repr(float(s)))
    return done.select("qa_id", F.col("x.value").cast("double").alias("value"), F.when(F.col("x.error").isNull(), "done").otherwise("failed").alias("state"))


_EXEMPLARS = """
    with s as (select q.vec_id as query_id, d.vec_id as doc_id, d.label >= 5 as high, round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 9) as similarity
               from embeddings q join embeddings d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id),
         r as (select *, row_number() over (partition by query_id, high order by similarity desc, doc_id) as n from s)"""


def _exemplars(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    d = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv"), (F.col("label") >= 5).alias("high"))
    return retrieval.nearest(q, d, 1, group="high")


@query(_EXEMPLARS + " select query_id, arg_max(high, (similarity, -doc_id)) as rated_high from r where n = 1 group by 1")
def leave_one_out_rating(spark: SparkSession, folder: str) -> DataFrame:
    """Each row rated as the more similar of its nearest high and its nearest low, never itself."""
    near = _exemplars(spark, folder)
    return near.groupBy("query_id").agg(F.max_by("high", F.struct("similarity", -F.col("doc_id"))).alias("rated_high"))


@query(_EXEMPLARS + """, p as (select query_id, max('Example ' || doc_id || ' is rated high') filter (high) as h, max('Example ' || doc_id || ' is rated low') filter (not high) as l from r where n = 1 group by 1)
    select query_id, concat_ws(chr(10) || chr(10), h, case when length(query_id::varchar) < 4 then l end, 'Rate ' || query_id || repeat(' again', length(query_id::varchar) * 2 - 2)) as prompt from p""")
def few_shot_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with one high and one low example, as far as the budget of tokens goes."""
    near = _exemplars(spark, folder)
    line = F.concat(F.lit("Example "), "doc_id", F.lit(" is rated "), F.when(F.col("high"), "high").otherwise("low"))
    shots = near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("high")).alias("k"), line.alias("x")))), lambda s: s["x"]).alias("shots"))
    task = F.concat(F.lit("Rate "), "query_id", F.repeat(F.lit(" again"), F.length(F.col("query_id").cast("string")) * 2 - 2))
    return shots.select("query_id", generation.few_shot(F.col("shots"), task, 16).alias("prompt"))


@query()
def topic_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """A topic model fitted on even ids, saved, loaded again, and the odd ids assigned to its topics."""
    e = load(spark, folder, "embeddings", "vec_id", "embedding")
    path = shared_path(spark, "topics")
    topics.fit(e.where("vec_id % 2 = 0"), "embedding").save(path)
    return topics.TopicModel.load(spark, path).assign(e.where("vec_id % 2 = 1"), "vec_id", "embedding")


@query("""
    with t as (select label % 7 as topic, unnest(range(len(embedding)))::int as i, unnest(embedding)::double as x from embeddings where label % 7 < 5),
         m as (select topic, i, avg(x) as x from t group by 1, 2), a as (select i, avg(x) as x from m group by 1)
    select label as topic, a.i, round(coalesce(m.x, a.x), 5) as x from (select distinct label from embeddings) l cross join a left join m on m.topic = l.label and m.i = a.i""")
def topic_vectors_default(spark: SparkSession, folder: str) -> DataFrame:
    """A vector for every topic: its own, or the mean of all where it has none."""
    e = load(spark, folder, "embeddings", "label", "embedding")
    own = topics.mean_vectors(e.where("label % 7 < 5").select((F.col("label") % 7).alias("topic"), "embedding"), "topic", "embedding")
    got = topics.with_default_vector(e.select(F.col("label").alias("topic")).distinct(), own, "topic", "mean")
    return got.select("topic", F.posexplode("mean").alias("i", "x")).select("topic", "i", F.round("x", 5).alias("x"))


@query("""
    with r as (select t.model, t.topic, cast(round(avg(epoch_us(c.published) // 1000000)) as bigint) as recency_s
               from article_topic t join cleaned_articles c on c.id = t.article_id where t.topic_prob >= 0.51 group by t.model, t.topic)
    select s.model || '-' || s.topic as key, s.model, s.topic, trim(s.summary) as description, r.recency_s, (length(s.summary) > 0) as has_vector
    from topic_summary s join r using (model, topic) where s.summary is not null""")
def topic_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index documents of topics: key, description with its vector, and recency."""
    found = topics.index_documents(
        load(spark, folder, "article_topic", "article_id", "model", "topic", "topic_prob"), load(spark, folder, "cleaned_articles", "id", "published"), load(spark, folder, "topic_summary")
    )
    return found.select("key", "model", "topic", "description", "recency_s", (F.size(F.filter("vector", lambda x: x != 0)) > 0).alias("has_vector"))


@query()
def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index documents of chunks: key, chunk with its vector, entities, and the topic's text, or none, with its vector or the mean."""
    newest = topics.latest_model(load(spark, folder, "topic_model")).select(F.col("id").alias("model"))
    best = load(spark, folder, "article_topic", "article_id", "model", "topic", "topic_prob").join(F.broadcast(newest), "model")  # one row
    best = best.groupBy(F.col("article_id").alias("id")).agg(F.max_by("topic", F.struct("topic_prob", "topic")).alias("topic"))
    rows = load(spark, folder, "cleaned_articles", "id", "title", "url", "published", "body").where("body is not null").dropDuplicates(["id"])
    return topics.chunk_documents(rows.join(best, "id", "left"), load(spark, folder, "topic_summary").join(F.broadcast(newest), "model"))


@query()
def topic_key_points(spark: SparkSession, folder: str) -> DataFrame:
    """Per query and topic the most telling articles made diverse, their key points, and of a query's topics the first two that have some."""
    newest = topics.latest_model(load(spark, folder, "topic_model")).select(F.col("id").alias("model"))
    a = load(spark, folder, "article_topic", "article_id", "model", "topic").join(F.broadcast(newest), "model").where("topic >= 0").select("article_id", "topic").distinct()  # one row
    d = load(spark, folder, "cleaned_articles", "id", "title", "summary", "published").where("title is not null").dropDuplicates(["id"])
    docs = a.join(d, a["article_id"] == d["id"]).select(F.concat_ws("|", "id", "topic").alias("doc_id"), "topic", F.col("title").alias("text"), "summary")
    q = load(spark, folder, "incoming_articles", "arrival_no", "title").where("arrival_no % 50 = 0 and title is not null").select(F.col("arrival_no").alias("query_id"), F.col("title").alias("text"))
    return retrieval.key_points(q, docs, topics_wanted=2)


_INFO = """
    with i as (select s_suppkey as id, case when s_suppkey % 5 = 0 then '0' else round(abs(s_acctbal), 2)::varchar end as cap, (s_suppkey % 7)::varchar as pe, s_nationkey from supplier)"""


@query(_INFO + """
    select id, g.title, g.key, g.label, case when v = '0' then 'N/A' else v end as value
    from i, (values ('Basic', 'marketCap', 'Market Cap($)'), ('Shares', 'trailingPE', 'P/E'), ('Basic', 'totalRevenue', 'Total Revenues($)')) g(title, key, label),
         lateral (select case key when 'marketCap' then cap when 'trailingPE' then pe else s_nationkey::varchar end as v) x where cap <> '0'""")
def kpi_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Key figures from nested JSON, by group, with labels, of companies that have a market capital."""
    return market.grouped(market.with_capital(_figures(spark, folder)))


def _figures(spark: SparkSession, folder: str) -> DataFrame:
    s = load(spark, folder, "supplier", "s_suppkey", "s_acctbal", "s_nationkey")
    cap = F.when(F.col("s_suppkey") % 5 == 0, "0").otherwise(F.round(F.abs("s_acctbal"), 2).cast("string"))
    raw = lambda c: F.concat(F.lit('{"raw": '), c, F.lit(', "fmt": "x"}'))
    json = F.concat(
        F.lit('{"price": {"marketCap": {"raw": 1}, "trailingPE": '), raw((F.col("s_suppkey") % 7).cast("string")), F.lit(', "empty": {}}, "summaryDetail": {"marketCap": '), raw(cap),
        F.lit(', "totalRevenue": '), F.col("s_nationkey").cast("string"), F.lit("}}"),
    )
    return market.figures(s.select(F.col("s_suppkey").alias("id"), json.alias("json")), "id", "json", ["price", "summaryDetail"])


@query(_INFO + """,
    n as (select distinct l_orderkey as query_id, l_suppkey as id from lineitem where l_orderkey % 50 = 0),
    b as (select user_id % 100 as id, arg_max(value, (epoch_us(ts), event_id)) as close from events group by 1),
    k as (select *, row_number() over (partition by query_id order by id) as r from n join i using (id) join b using (id) where cap <> '0')
    select query_id, id, round(close, 6) as close, 'Market Cap($)' as label, cap as value from k where r <= 3""")
def screener(spark: SparkSession, folder: str) -> DataFrame:
    """Companies named by a query with their last price and figures, three at most."""
    names = load(spark, folder, "lineitem", "l_orderkey", "l_suppkey").where("l_orderkey % 50 = 0").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("id"))
    last = load(spark, folder, "events", "event_id", "user_id", "ts", "value").groupBy((F.col("user_id") % 100).alias("id")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    found = market.screener(names, _figures(spark, folder), last).where("label = 'Market Cap($)'")
    return found.select("query_id", "id", F.round("close", 6).alias("close"), "label", "value")


@query(" union all ".join(f"""
    select '{p}' as period, event_type, epoch_us(time_bucket(interval '{w}', ts)) // 1000000 as start_s, count(*) as n, max(value) as high
    from events where ts > (select max(ts) from events) - interval '{d} days' group by 1, 2, 3""" for p, w, d in (("1d", "30 minutes", 1), ("5d", "1 hour", 5), ("1mo", "1 day", 30))))
def bars_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of three periods up to the newest event, half an hour, an hour and a day wide."""
    e = load(spark, folder, "events", "event_id", "event_type", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = e.agg(F.max("ts").alias("now"))
    e = e.crossJoin(F.broadcast(newest))  # one row
    out = None
    for period in ("1d", "5d", "1mo"):
        b = market.bars(e, "event_type", "ts", "value", "event_id", period, F.col("now")).select(F.lit(period).alias("period"), "event_type", F.unix_seconds("start").alias("start_s"), "n", "high")
        out = b if out is None else out.unionByName(b)
    return out


@query("""
    with w as (select id as doc, list_filter(string_split(regexp_replace(lower(title), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') as t
               from (select id, min(title) as title from incoming_articles where title is not null group by id)),
         s as (select doc, unnest(list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')))) as x from w where len(t) >= 3),
         h as (select doc, seed, min(('0x' || left(sha1(seed || '-' || x), 15))::bigint) as m from s, (select unnest(range(50))::int as seed) group by 1, 2)
    select doc, list(m order by seed) as sig from h group by 1""")
def salted_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """MinHash signatures by fifty salted sha1 functions, over titles' runs of three words."""
    t = load(spark, folder, "incoming_articles", "id", "title").where("title is not null").groupBy("id").agg(F.min("title").alias("title"))
    docs = t.select(F.col("id").alias("doc"), F.regexp_replace("title", r"\s+", " ").alias("text"))
    return dedup.salted_signatures(docs, 50, 3)


@query("""
    with recursive d as (select id, coalesce(title, '') as title from (select id, min(title) as title from incoming_articles group by id))
    select count(*) as documents, count(distinct title) as unique_titles, count(*) - count(distinct title) as duplicates from d""")
def duplicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "incoming_articles", "id", "title").groupBy("id").agg(F.coalesce(F.min("title"), F.lit("")).alias("title"))
    return t.agg(F.count("*").alias("documents"), F.countDistinct("title").alias("unique_titles")).withColumn("duplicates", F.col("documents") - F.col("unique_titles"))


@query("""
    select qa_id as query_id, trim(answerable) as query_text from augmented_qa where length(trim(answerable)) >= 5""")
def corpus_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of a retrieval corpus: ids as numbers, texts stripped, those under five characters left out."""
    t = load(spark, folder, "augmented_qa", "qa_id", "answerable")
    return language_tools.corpus_texts(t, "qa_id", "answerable", 5).toDF("query_id", "query_text")


@query("select doc_id, regexp_replace(regexp_replace(text, '^[\\s\\x{A0}]+', ''), '[\\s\\x{A0}]+$', '') as doc_text from documents where length(regexp_replace(regexp_replace(text, '^[\\s\\x{A0}]+', ''), '[\\s\\x{A0}]+$', '')) >= 10")
def corpus_documents(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "documents", "doc_id", "text")
    return language_tools.corpus_texts(t, "doc_id", "text", 10).toDF("doc_id", "doc_text")
