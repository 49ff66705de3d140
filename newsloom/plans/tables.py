"""Queries over the warehouse tables: scans, filters, joins, aggregates, windows, sampling, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.catalog import load
from newsloom.functions import quantiles
from newsloom.operators import curation, topics
from newsloom.operators.dedup import keep_first

NOW = "2024-11-27 00:00:00"
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def day(c: str):
    """Days since 1970-01-01 UTC, whatever the session's zone."""
    return F.floor(F.unix_micros(c) / 86_400_000_000).cast("int")


def _latest(spark: SparkSession, folder: str) -> str | None:
    row = topics.latest_model(load(spark, folder, "topic_model")).first()
    return row and row["id"]


LATEST = "(select id from topic_model order by fit_date desc, id limit 1)"


@query("select id, source from scraped_articles where epoch_us(scraped_at) >= 1732665600000000 - 210 * 86400000000::bigint")
def recent_articles_window(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", "id", "source", "scraped_at")
    since = F.expr(f"timestamp '{NOW} UTC' - interval 210 days")
    return t.where(F.col("scraped_at") >= since).select("id", "source")


@query("select distinct id, title from cleaned_articles where epoch_us(published) >= (select max(epoch_us(published)) from cleaned_articles) - 183 * 86400000000::bigint and body is not null")
def fit_window(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of the last half year, which a topic model is fitted on."""
    t = load(spark, folder, "cleaned_articles", "id", "title", "body", "published")
    since = t.agg((F.max("published") - F.expr("interval 183 days")).alias("since"))
    return t.where("body is not null").crossJoin(F.broadcast(since)).where("published >= since").select("id", "title").distinct()  # one row


@query("""
    select a.id, exists(select 1 from article_topic t where t.article_id = a.id) as known
    from (select distinct id from cleaned_articles where epoch_us(published) < 1732665600000000) a""")
def exists_flag_incremental(spark: SparkSession, folder: str) -> DataFrame:
    a = load(spark, folder, "cleaned_articles", "id", "published").where(F.col("published") < F.expr(f"timestamp '{NOW} UTC'"))
    known = load(spark, folder, "article_topic", "article_id").distinct()
    ids = a.select("id").distinct()
    return ids.join(known, ids["id"] == known["article_id"], "left").select("id", F.col("article_id").isNotNull().alias("known"))


@query(f"""
    select distinct c.id from cleaned_articles c
    where not exists (select 1 from article_topic t where t.article_id = c.id and t.model = {LATEST})""")
def topicless_articles(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "cleaned_articles", "id")
    t = load(spark, folder, "article_topic", "article_id", "model")
    return topics.without_topic(c, t, _latest(spark, folder)).select("id").distinct()


@query(f"""
    with j as (select distinct c.id, c.body, t.topic from cleaned_articles c join article_topic t on c.id = t.article_id
               where t.model = {LATEST} and c.body is not null)
    select id, topic from (select *, row_number() over (partition by body order by id, topic) as n from j) where n = 1""")
def articles_by_topic_distinct_body(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "cleaned_articles", "id", "body").where("body is not null")
    t = load(spark, folder, "article_topic", "article_id", "model", "topic").where(F.col("model") == _latest(spark, folder))
    j = c.join(t, c["id"] == t["article_id"]).select("id", "body", "topic").distinct()
    return keep_first(j, ["body"], F.col("id"), F.col("topic")).select("id", "topic")


@query(f"""
    with r as (select t.model, t.topic, cast(round(avg(epoch_us(c.published) // 1000000)) as bigint) as recency_s
               from article_topic t join cleaned_articles c on c.id = t.article_id
               where t.topic_prob >= 0.51 and t.model = {LATEST} group by t.model, t.topic)
    select r.model, r.topic, recency_s, s.summary from r join topic_summary s on s.model = r.model and s.topic = r.topic""")
def topic_recency(spark: SparkSession, folder: str) -> DataFrame:
    """Mean publication second of the newest model's topics, with their summaries."""
    return topics.recency(
        load(spark, folder, "article_topic", "article_id", "model", "topic", "topic_prob"),
        load(spark, folder, "cleaned_articles", "id", "published"),
        load(spark, folder, "topic_summary"),
        topics.latest_model(load(spark, folder, "topic_model")),
    )


@query("""
    select a.article_id, a.model, a.topic, coalesce(s.summary, '') as topic_text
    from article_topic a left join topic_summary s on a.model = s.model and a.topic = s.topic""")
def chunk_topic_default(spark: SparkSession, folder: str) -> DataFrame:
    a = load(spark, folder, "article_topic", "article_id", "model", "topic")
    return topics.with_summary(a, load(spark, folder, "topic_summary")).select("article_id", "model", "topic", "topic_text")


@query("select id, path from topic_model order by fit_date desc, id limit 1")
def latest_model_top1(spark: SparkSession, folder: str) -> DataFrame:
    return topics.latest_model(load(spark, folder, "topic_model")).select("id", "path")


@query("select id from topic_model where servable order by fit_date desc, id limit 1")
def latest_servable_model(spark: SparkSession, folder: str) -> DataFrame:
    return topics.latest_model(load(spark, folder, "topic_model"), servable=True).select("id")


@query("select id from topic_model where epoch_us(fit_date) >= 1636156800000000 - 5 * 86400000000::bigint order by fit_date desc, id limit 1")
def model_within_ttl(spark: SparkSession, folder: str) -> DataFrame:
    since = F.expr("timestamp '2021-11-06 00:00:00 UTC' - interval 5 days")
    return topics.latest_model(load(spark, folder, "topic_model"), since=since).select("id")


@query("select id, body is not null as has_body from cleaned_articles where summary_type = 'BULLETS'")
def bullet_summaries(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "body", "summary_type").where("summary_type = 'BULLETS'")
    return t.select("id", F.col("body").isNotNull().alias("has_body"))


@query("select distinct url from scraped_articles where url is not null")
def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "scraped_articles", "url").where("url is not null").distinct()


@query("""
    select id from (select id, row_number() over (partition by body order by id) as n
                    from (select distinct id, body from scraped_articles where body is not null)) where n = 1""")
def exact_dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", "id", "body").where("body is not null").distinct()
    return keep_first(t, ["body"], F.col("id")).select("id")


@query("select distinct article_id, model, topic, topic_prob from article_topic")
def exact_dedup_multi_col(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "article_topic", "article_id", "model", "topic", "topic_prob").dropDuplicates()


@query("""
    select c_mktsegment as segment, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    where l_shipdate >= timestamp '1995-01-01' group by 1""")
def joined_three_tables(spark: SparkSession, folder: str) -> DataFrame:
    li = load(spark, folder, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate >= timestamp_ntz '1995-01-01'")
    o = load(spark, folder, "orders", "o_orderkey", "o_custkey")
    c = load(spark, folder, "customer", "c_custkey", "c_mktsegment")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n_lines"), revenue.alias("revenue"))


@query("select c.id, t.topic from cleaned_articles c join article_topic t on c.id = t.article_id")
def semi_join_that_repeats(spark: SparkSession, folder: str) -> DataFrame:
    c, t = load(spark, folder, "cleaned_articles", "id"), load(spark, folder, "article_topic", "article_id", "topic")
    return c.join(t, c["id"] == t["article_id"]).select("id", "topic")


@query("select doc_id from documents where source is null or source not in (select source from mix_targets)")
def not_in_list(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents", "doc_id", "source").join(load(spark, folder, "mix_targets", "source"), "source", "left_anti").select("doc_id")


@query("select m.id as model, s.source from topic_model m cross join mix_targets s")
def models_times_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables of fixed size."""
    return load(spark, folder, "topic_model", "id").crossJoin(load(spark, folder, "mix_targets", "source")).select(F.col("id").alias("model"), "source")


@query("""
    select (epoch_us(published) // 86400000000)::int as day, sum(len(string_split(body, ' ')))::bigint as words
    from cleaned_articles where body is not null and published is not null group by 1""")
def words_per_day(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "published", "body").where("body is not null and published is not null")
    return t.groupBy(day("published").alias("day")).agg(F.sum(F.size(F.split("body", " "))).alias("words"))


@query("""
    select l_returnflag as flag, l_linestatus as status, max(l_quantity) as most, max(l_tax) as most_tax from lineitem group by 1, 2""")
def group_max(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    return t.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.max("l_quantity").alias("most"), F.max("l_tax").alias("most_tax"))


@query("""
    select model, round(avg(topic_prob), 6) as mean, round(stddev_samp(topic_prob) / sqrt(count(topic_prob)), 6) as error, count(*) as n
    from article_topic group by model""")
def group_mean_error(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "article_topic", "model", "topic_prob")
    error = F.stddev_samp("topic_prob") / F.sqrt(F.count("topic_prob"))
    return t.groupBy("model").agg(F.round(F.avg("topic_prob"), 6).alias("mean"), F.round(error, 6).alias("error"), F.count("*").alias("n"))


@query("""
    select event_type, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as q2, round(quantile_cont(value, 0.75), 6) as q3
    from events group by 1""")
def group_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "events", "event_type", "value")
    p = quantiles.exact(t, "event_type", "value", (0.25, 0.5, 0.75))
    return p.select("event_type", *[F.round(f"p{i}", 6).alias(f"q{i + 1}") for i in range(3)])


@query("""
    select count(n_chars) as n, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 6) as sd, min(n_chars) as least,
           round(quantile_cont(n_chars, 0.25), 6) as q1, round(quantile_cont(n_chars, 0.5), 6) as q2, round(quantile_cont(n_chars, 0.75), 6) as q3, max(n_chars) as most
    from documents""")
def describe_lengths(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "documents", "n_chars")
    p = quantiles.exact(t.withColumn("g", F.lit(0)), "g", "n_chars", (0.25, 0.5, 0.75))
    t = t.agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("sd"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    both = t.join(F.broadcast(p), F.lit(True), "left")  # one row each
    return both.select("n", "mean", "sd", "least", *[F.round(f"p{i}", 6).alias(f"q{i + 1}") for i in range(3)], "most")


_COUNTED = ("source", "title", "published", "body", "summary", "category", "html")


@query("select " + ", ".join(f"count(*) - count({c}) as {c}" for c in _COUNTED) + " from scraped_articles")
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", *_COUNTED)
    return t.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _COUNTED])


@query("select round(avg(abs(topic_prob - 0.5)), 6) as mae from article_topic")
def mae(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "article_topic", "topic_prob").agg(F.round(F.avg(F.abs(F.col("topic_prob") - 0.5)), 6).alias("mae"))


@query("""
    select l_orderkey as order_key, list_sort(list(l_partkey)) as members, count(*) as n from lineitem group by 1""")
def list_concat_group(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of groups whose size the schema bounds: the lines of an order."""
    t = load(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    return t.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list("l_partkey")).alias("members"), F.count("*").alias("n"))


@query("""
    with e as (select label, unnest(range(len(embedding)))::int as i, unnest(embedding) as x from embeddings)
    select label, i, round(avg(x::double), 5) as mean from e group by 1, 2""")
def mean_embedding(spark: SparkSession, folder: str) -> DataFrame:
    m = topics.mean_vectors(load(spark, folder, "embeddings", "label", "embedding"), "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 5).alias("mean"))


@query("""
    select user_id, event_id from (
        select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n between 2 and 4""")
def history_last_k(spark: SparkSession, folder: str) -> DataFrame:
    """The last three turns before the current one."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    t = load(spark, folder, "events", "user_id", "event_id", "ts").withColumn("n", F.row_number().over(w))
    return t.where("n between 2 and 4").select("user_id", "event_id")


@query("""
    with s as (select id, unnest(string_split(body, chr(10) || chr(10))) as part, unnest(range(len(string_split(body, chr(10) || chr(10)))))::int as pos
               from (select distinct id, body from cleaned_articles where body is not null))
    select id, pos, coalesce(string_agg(part, ' | ' order by pos) over (partition by id order by pos rows between 5 preceding and 1 preceding), '') as context from s""")
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five paragraphs before each one, within its article."""
    t = load(spark, folder, "cleaned_articles", "id", "body").where("body is not null").distinct()
    s = t.select("id", F.posexplode(F.split("body", "\n\n")).alias("pos", "part"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(-5, -1)
    return s.select("id", "pos", F.array_join(F.collect_list("part").over(w), " | ").alias("context"))


@query("select qa_id, answer from augmented_qa where answer is distinct from 'FAILED' and answer is distinct from 'N/A'")
def null_safe_inequality(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "answer")
    return t.where(~F.col("answer").eqNullSafe("FAILED") & ~F.col("answer").eqNullSafe("N/A"))


@query("select count(*) as n from scraped_articles where source is not null and body is not null and summary is not null")
def drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "scraped_articles", "source", "body", "summary").na.drop(subset=["source", "body", "summary"]).agg(F.count("*").alias("n"))


@query("select article_id, topic from article_topic where topic_prob >= 0.51 and topic >= 0")
def topic_probability_filter(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "article_topic", "article_id", "topic", "topic_prob")
    return t.where((F.col("topic_prob") >= 0.51) & (F.col("topic") >= 0)).select("article_id", "topic")


@query("""
    select event_id, case when value > 3 then 'h' else 'l' end as rating,
           case event_type when 'click' then 0 when 'view' then 1 else 2 end as code from events""")
def rating_and_code(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "events", "event_id", "value", "event_type")
    codes = F.create_map(F.lit("click"), F.lit(0), F.lit("view"), F.lit(1))
    code = F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit(2))
    return t.select("event_id", F.when(F.col("value") > 3, "h").otherwise("l").alias("rating"), code.alias("code"))


@query("""
    select id, case when length(title) < length(category) then category else title end as title,
           case when length(title) < length(category) then title else category end as category from cleaned_articles""")
def swap_short_title(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "title", "category")
    short = F.length("title") < F.length("category")
    return t.select("id", F.when(short, F.col("category")).otherwise(F.col("title")).alias("title"), F.when(short, F.col("title")).otherwise(F.col("category")).alias("category"))


@query("""
    select doc_id, (select max(doc_id) from documents) + row_number() over (order by doc_id) as new_id
    from documents where source = 'oakmeter'""")
def ids_after_max(spark: SparkSession, folder: str) -> DataFrame:
    """New ids follow the greatest."""
    t = load(spark, folder, "documents", "doc_id", "source")
    top = t.agg(F.max("doc_id").alias("top"))
    rows = curation.numbered(t.where("source = 'oakmeter'").select("doc_id"), "doc_id")
    return rows.crossJoin(F.broadcast(top)).select("doc_id", (F.col("top") + F.col("n") + 1).alias("new_id"))  # one row


@query("select doc_id, row_number() over (order by sha1(doc_id::varchar || '|93')) - 1 as place from documents")
def full_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """All rows in the order of a seeded hash, with their places."""
    t = load(spark, folder, "documents", "doc_id").withColumn("h", F.sha1(F.concat(F.col("doc_id").cast("string"), F.lit("|93"))))
    return curation.numbered(t, "h").select("doc_id", F.col("n").alias("place"))


@query("select doc_id from documents order by sha1(doc_id::varchar || '|93'), doc_id limit 100")
def capped_sample(spark: SparkSession, folder: str) -> DataFrame:
    """An exact-size sample without replacement, in the order of a seeded hash (a sampling operator)."""
    t = load(spark, folder, "documents", "doc_id")
    return t.orderBy(F.sha1(F.concat(F.col("doc_id").cast("string"), F.lit("|93"))), "doc_id").limit(100)


@query("select doc_id from documents where ('0x' || left(sha1(doc_id::varchar || '|7'), 7))::bigint < 0.1 * 268435456")
def fraction_sample(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "documents", "doc_id")
    h = F.conv(F.substring(F.sha1(F.concat(F.col("doc_id").cast("string"), F.lit("|7"))), 1, 7), 16, 10).cast("long")
    return t.where(h < 0.1 * 268435456)


@query("""
    with r as (select doc_id, category, row_number() over (partition by category order by sha1(doc_id::varchar || '|345'), doc_id) as n from documents where category is not null)
    select doc_id, category, case when n <= 10 then 'test' else 'train' end as split from r""")
def stratified_split_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Ten test rows per stratum exactly: the tenth hash of each stratum is the threshold, so that only ten
    rows per stratum and task are ordered."""
    t = load(spark, folder, "documents", "doc_id", "category").where("category is not null")
    t = t.withColumn("h", F.sha1(F.concat(F.col("doc_id").cast("string"), F.lit("|345"))))
    w = Window.partitionBy("category").orderBy("h", "doc_id")
    first = t.withColumn("n", F.row_number().over(w)).where("n <= 10").groupBy("category").agg(F.max(F.struct("h", "doc_id")).alias("last"))
    split = F.when(F.struct("h", "doc_id") <= F.col("last"), "test").otherwise("train")
    return t.join(first, "category").select("doc_id", "category", split.alias("split"))


@query("""
    with o as (select doc_id, source, row_number() over (partition by source order by sha1(doc_id::varchar), doc_id) as n from documents),
         c as (select count(*) filter (source = 'ostervale') as t, count(*) filter (source = 'oakmeter') as f, count(*) filter (source = 'tarnwire') as w from documents),
         m as (select t, least(floor(0.25 * t), f) as numeric_n, least(t + least(floor(0.25 * t), f), w) as generic_n from c)
    select doc_id, case source when 'ostervale' then 'base' when 'oakmeter' then 'numeric' else 'generic' end as kind from o, m
    where source = 'ostervale' or (source = 'oakmeter' and n <= numeric_n) or (source = 'tarnwire' and n <= generic_n)""")
def balanced_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All of one source, of the numeric one as many as a quarter of it, of the generic one as many as both."""
    t = load(spark, folder, "documents", "doc_id", "source")
    base, numeric, generic = (t.where(F.col("source") == s).select("doc_id", F.lit(k).alias("kind")) for s, k in (("ostervale", "base"), ("oakmeter", "numeric"), ("tarnwire", "generic")))
    return curation.balanced(base, numeric, generic, "doc_id")


@query("""
    select url, min(batch_no) as first_batch from (
        select url, 0 as batch_no from cleaned_articles union all select url, batch_no from incoming_articles) where url is not null group by url""")
def union_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    a = load(spark, folder, "cleaned_articles", "url").withColumn("batch_no", F.lit(0))
    b = load(spark, folder, "incoming_articles", "url", "batch_no")
    return a.unionByName(b).where("url is not null").groupBy("url").agg(F.min("batch_no").alias("first_batch"))


@query("select distinct upper(source) as ticker from scraped_articles where source is not null")
def distinct_upper(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "scraped_articles", "source").where("source is not null").select(F.upper("source").alias("ticker")).distinct()


@query("""
    with o as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as parts from lineitem group by 1)
    select l_orderkey, unnest(range(1, len(parts) + 1))::int as pos, unnest(parts) as part from o""")
def nested_explode(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays of structs built per order and taken apart by position."""
    t = load(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    o = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("parts"))
    return o.select("l_orderkey", F.posexplode("parts").alias("p", "x")).select("l_orderkey", (F.col("p") + 1).alias("pos"), F.col("x.l_partkey").alias("part"))


@query("""
    with p as (select l_orderkey, l_linenumber % 3 as ord, arg_max(l_partkey::varchar, (l_linenumber, l_partkey::varchar)) as part from lineitem group by 1, 2)
    select l_orderkey, concat_ws(' ', max(part) filter (ord = 2), max(part) filter (ord = 0)) as said from p group by 1""")
def nested_join(spark: SparkSession, folder: str) -> DataFrame:
    """Within each document, the paragraphs that a question names by their order, the last of equal ones, as one text."""
    t = load(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    paragraph = F.struct("l_linenumber", (F.col("l_linenumber") % 3).alias("ord"), F.col("l_partkey").cast("string").alias("text"))
    docs = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(paragraph)).alias("paragraphs"))  # the lines of an order
    named = F.transform(F.array(F.lit(2), F.lit(0)), lambda r: F.try_element_at(F.filter("paragraphs", lambda p: p["ord"] == r), F.lit(-1))["text"])
    return docs.select("l_orderkey", F.array_join(named, " ").alias("said"))


@query("""
    select id, model, topic, model || '-' || topic as key from (
        select topic_model.id, s.model, s.topic from topic_summary s join topic_model on topic_model.id = s.model where s.summary is not null)""")
def topic_index_docs(spark: SparkSession, folder: str) -> DataFrame:
    s = load(spark, folder, "topic_summary").where("summary is not null")
    m = load(spark, folder, "topic_model", "id")
    return s.join(m, s["model"] == m["id"]).select("id", "model", "topic", F.concat_ws("-", "model", F.col("topic").cast("string")).alias("key"))


@query(f"select id, case when id = {LATEST} then true else servable end as servable from topic_model")
def flip_servable(spark: SparkSession, folder: str) -> DataFrame:
    m = load(spark, folder, "topic_model", "id", "servable")
    return m.select("id", F.when(F.col("id") == _latest(spark, folder), True).otherwise(F.col("servable")).alias("servable"))


@query("""
    with new as (select vec_id, label + 1 as label from embeddings where vec_id % 3 = 0)
    select e.vec_id, coalesce(n.label, e.label) as label from embeddings e left join new n using (vec_id)""")
def upsert_index(spark: SparkSession, folder: str) -> DataFrame:
    from newsloom.sources.tables import upsert

    old = load(spark, folder, "embeddings", "vec_id", "label")
    return upsert(old, old.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 1), ["vec_id"])
