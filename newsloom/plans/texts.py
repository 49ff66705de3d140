"""Queries on text, dates, JSON, duplicates, curation and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.catalog import load
from newsloom.functions import text as T
from newsloom.functions.stage import staged
from newsloom.operators import curation, dedup, evaluation, topics
from newsloom.operators.graphs import connected_components
from newsloom.operators.urls import canonical_url
from newsloom.session import checkpointed

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STRIP = "regexp_replace(regexp_replace({}, '^[\\s\\x{{A0}}]+', ''), '[\\s\\x{{A0}}]+$', '')"


@query("select id, " + _STRIP.format("regexp_replace(title, '[\\s\\x{A0}]+', ' ', 'g')") + " as title from cleaned_articles")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "title")
    return t.select("id", T.normalize_text(F.col("title")).alias("title"))


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\n+', chr(10), 'g'), '^[\\s\\x{A0}]+', ''), '[\\s\\x{A0}]+$', '') as text from documents")
def collapse_newlines(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "documents", "doc_id", "text")
    return t.select("doc_id", T.collapse_newlines(F.col("text")).alias("text"))


@query("""
    select id, trim(split_part(summary, chr(10) || '*', 1)) as headline, len(string_split(summary, chr(10) || '*')) - 1 as points
    from cleaned_articles where summary_type = 'BULLETS' and summary is not null""")
def bullet_split(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "summary", "summary_type").where("summary_type = 'BULLETS' and summary is not null")
    s = t.select("id", T.split_bullets(F.col("summary")).alias("s"))
    return s.select("id", F.col("s.headline"), F.size("s.points").cast("long").alias("points"))


@query("""
    with i as (select id, list_transform(string_split(summary, chr(10)), lambda x: regexp_replace(x, '^\\* ', '')) as items from cleaned_articles where summary is not null)
    select id, case when len(items) = 1 then case when items[1] = '' then 'NULL' else 'PLAIN' end else 'BULLETS' end as summary_type,
           case when len(items) = 1 then items[1] else array_to_string(list_transform(items, lambda x: '* ' || x || chr(10)), '') end as summary from i""")
def bullets_consolidate(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "summary").where("summary is not null")
    items = F.transform(F.split("summary", "\n"), lambda x: F.regexp_replace(x, r"^\* ", ""))
    return t.select("id", T.consolidate_summary(items).alias("s")).select("id", "s.*")


@query("select doc_id, regexp_replace(text, '\\[\\d+\\]', '', 'g') as text from documents")
def citation_strip(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "documents", "doc_id", "text")
    return t.select("doc_id", T.strip_citations(F.col("text")).alias("text"))


@query("""
    select id, replace(regexp_replace(title, '([_*\\[\\]()~`>#+=|{}.!-])', '\\\\\\1', 'g'), '$', '＄') as title,
           replace(regexp_replace(title, '([_*`\\[])', '\\\\\\1', 'g'), '$', '＄') as old_title from cleaned_articles""")
def markdown_escape(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "title")
    return t.select("id", T.markdown_escape(F.col("title")).alias("title"), T.markdown_escape(F.col("title"), 1).alias("old_title"))


@query("""
    with t as (select distinct p_brand || '.' || p_size % 3 as ticker from part where p_size % 2 = 0 union select distinct p_brand from part)
    select ticker, unnest(case when contains(ticker, '.') then [ticker, split_part(ticker, '.', 1)] else [ticker] end) as form from t""")
def ticker_split(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "part", "p_brand", "p_size")
    t = p.where("p_size % 2 = 0").select(F.concat("p_brand", F.lit("."), (F.col("p_size") % 3).cast("string")).alias("ticker"))
    t = t.union(p.select("p_brand")).distinct()
    return t.select("ticker", F.explode(T.ticker_forms(F.col("ticker"))).alias("form"))


@query("""
    select id, 'Published: ' || strftime(timestamp '1970-01-01' + to_microseconds(epoch_us(published)), '%Y-%m-%d') || chr(10) || title as text
    from cleaned_articles where published is not null""")
def publish_prefix(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "title", "published").where("published is not null")
    return t.select("id", T.published_prefix(F.col("published"), F.col("title")).alias("text"))


@query("""
    select id, case when source = 'tarnwire' and contains(body, ' - ') then substr(body, instr(body, ' - ') + 3) else body end as body from scraped_articles where body is not null""")
def intro_strip(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", "id", "source", "body").where("body is not null")
    return t.select("id", T.strip_intro(F.col("body"), F.coalesce("source", F.lit("")), "tarnwire").alias("body"))


@query("select id, case when contains(summary, '* ') then regexp_extract(summary, '(?s)\\*\\s*(.+)\\z', 1) else '' end as rest from cleaned_articles where summary is not null")
def context_extract(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "summary").where("summary is not null")
    return t.select("id", F.when(F.col("summary").contains("* "), T.between(F.col("summary"), r"\*")).otherwise("").alias("rest"))


@query("""
    select qa_id, answer from augmented_qa where len(list_filter(string_split(answer, ' '), lambda w: regexp_matches(w, '^[A-Za-z]+$'))) > length(regexp_replace(answer, '[^0-9]', '', 'g'))""")
def alpha_vs_digit_filter(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "answer").where("answer is not null")
    return t.where(T.alpha_words(F.col("answer")) > T.digit_chars(F.col("answer")))


@query("select qa_id from augmented_qa where not (contains(lower(answer), 'not possible') or contains(lower(answer), 'cannot answer'))")
def refusal_filter(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "answer").where("answer is not null")
    low = F.lower("answer")
    return t.where(~(low.contains(T.REFUSAL_MARKERS[0]) | low.contains(T.REFUSAL_MARKERS[1]))).select("qa_id")


@query("select qa_id, answer from augmented_qa where answer is not null and not contains(answer, '#') and answer not in ('no', 'yes', 'Yes', 'No', 'No,', 'Yes,', 'No.', 'Yes.', 'yes.', 'no.')")
def yes_no_filter(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "answer").where("answer is not null")
    return t.where(~F.col("answer").contains("#") & ~F.col("answer").isin(*T.YES_NO))


@query("select qa_id, case when contains(lower(answer), 'impossible') then 'IMPOSSIBLE' else answer end as answer from augmented_qa")
def impossible_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "answer")
    hit = F.coalesce(F.lower("answer").contains("impossible"), F.lit(False))
    return t.select("qa_id", F.when(hit, "IMPOSSIBLE").otherwise(F.col("answer")).alias("answer"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0) as k from events")
def safe_numeric_fill(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "events", "event_id", "props")
    return t.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("k"))


@query("""
    select distinct id, epoch_us(strptime(published, '%Y-%m-%dT%H:%M:%SZ'))::bigint as us from scraped_articles
    where regexp_matches(published, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$') and try_strptime(published, '%Y-%m-%dT%H:%M:%SZ') is not null""")
def parse_iso_dates(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", "id", "published")
    t = t.where(F.col("published").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"))
    us = F.unix_micros(F.try_to_timestamp("published", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return t.select("id", us.alias("us")).where("us is not null").distinct()


@query("""
    select event_id, (epoch_us(ts) // 86400000000)::int as day, strftime(ts, '%Y-%m-%d, %A') as label from events""")
def epoch_days(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "events", "event_id", "ts")
    return t.select("event_id", F.unix_date(F.to_date("ts")).alias("day"), F.date_format("ts", "yyyy-MM-dd, EEEE").alias("label"))


@query("""
    with w as (select id, list_filter(string_split(regexp_replace(lower(body), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') as t
               from (select distinct id, body from cleaned_articles where body is not null))
    select id, len(t) as tokens, len(list_distinct(case when len(t) >= 10 then list_transform(range(1, len(t) - 8), lambda i: array_to_string(t[i:i + 9], ' ')) else []::varchar[] end)) as shingles from w""")
def shingle_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "body").where("body is not null").distinct()
    flat = F.regexp_replace("body", r"\s+", " ")
    t = staged(t, ["id"], {"t": T.tokens(flat)})
    return t.select("id", F.size("t").cast("long").alias("tokens"), F.size(dedup.shingles(F.col("t"))).cast("long").alias("shingles"))


_MINHASH = """
    with w as (select doc, list_filter(string_split(regexp_replace(lower(title || ' ' || body), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') as t
               from (select id || '#' || row_number() over (partition by id order by title, body) as doc, title, body
                     from (select distinct id, title, body from incoming_articles where body is not null and title is not null))),
         s as (select doc, unnest(list_distinct(list_transform(range(1, len(t) - 8), lambda i: array_to_string(t[i:i + 9], ' ')))) as x from w where len(t) >= 10),
         h as (select doc, ('0x' || right(sha1(x), 8))::bigint % 2147483647 as h from s),
         m as (select doc, {mins} from h group by doc)
""".format(mins=", ".join(f"min((h * {a} + {b}) % 2147483647) as m{i}" for i, (a, b) in enumerate(dedup.permutations())))


def _minhash_docs(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "incoming_articles", "id", "title", "body").where("body is not null and title is not null")
    t = dedup.versions(t, "id", "title", "body")
    return t.select("doc", F.regexp_replace(F.concat_ws(" ", "title", "body"), r"\s+", " ").alias("text"))


@query(_MINHASH + "select doc, [" + ", ".join(f"m{i}" for i in range(50)) + "] as sig from m")
def minhash_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.signatures(_minhash_docs(spark, folder))


_BANDED = _MINHASH + ", k as (" + " union all ".join(
    f"select doc, {i} as band, " + " || ' ' || ".join(f"m{j}" for j in range(5 * i, 5 * i + 5)) + " as bucket from m" for i in range(10)
) + "), p as (select distinct x.doc as a, y.doc as b from k x join k y on x.band = y.band and x.bucket = y.bucket and x.doc < y.doc)"


@query(_BANDED + " select a, b from p")
def lsh_candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.candidate_pairs(checkpointed(dedup.signatures(_minhash_docs(spark, folder))))


_VERIFIED = _BANDED + ", l as (select doc, [" + ", ".join(f"m{i}" for i in range(50)) + """] as sig from m),
    v as (select a, b, len(list_intersect(x.sig, y.sig)) / len(list_distinct(x.sig || y.sig)) as similarity
          from p join l x on x.doc = a join l y on y.doc = b)"""


@query(_VERIFIED + " select a, b, round(similarity, 6) as similarity from v where similarity >= 0.5")
def near_dup_pairs_verified(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.similar_pairs(_minhash_docs(spark, folder)).withColumn("similarity", F.round("similarity", 6))


@query(_VERIFIED.replace("    with w as", "    with recursive w as", 1) + """, e as (select a, b from v where similarity >= 0.5 union select b, a from v where similarity >= 0.5),
    c(node, seen) as (select a, a from e union select e.b, c.seen from c join e on e.a = c.node)
    select node, min(seen) as component from c group by node""")
def dup_components(spark: SparkSession, folder: str) -> DataFrame:
    return connected_components(dedup.similar_pairs(_minhash_docs(spark, folder)))


_CLEAN = """
    with recursive o as (select id, title, body, true as known from cleaned_articles where body is not null union all select id, title, body, false from incoming_articles where body is not null),
         g as (select id, title, body, bool_or(known) as known from o group by all),
         n as (select id || '#' || row_number() over (partition by id order by title nulls first, body, known) as doc, title, body, known from g),
         u as (select doc, known, title, body from (select *, row_number() over (partition by body order by known desc, doc) as k from n) where k = 1),
         w as (select doc, list_filter(string_split(regexp_replace(lower(concat_ws(' ', title, body)), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') as t from u),
""" + _VERIFIED[_VERIFIED.index("         s as (select doc"):] + """,
    e as (select a, b from v where similarity >= 0.5 union select b, a from v where similarity >= 0.5),
    c(node, seen) as (select a, a from e union select e.b, c.seen from c join e on e.a = c.node),
    z as (select u.doc, u.known, coalesce(q.component, u.doc) as component from u left join (select node, min(seen) as component from c group by node) q on q.node = u.doc)
    select doc, component from (select *, row_number() over (partition by component order by known desc, doc) as k from z) where k = 1 and not known"""


@query(_CLEAN)
def near_dup_clean(spark: SparkSession, folder: str) -> DataFrame:
    """New articles without near-duplicates among themselves and of the accepted ones."""
    old = load(spark, folder, "cleaned_articles", "id", "title", "body").withColumn("known", F.lit(True))
    new = load(spark, folder, "incoming_articles", "id", "title", "body").withColumn("known", F.lit(False))
    t = old.unionByName(new).where("body is not null").groupBy("id", "title", "body").agg(F.max("known").alias("known"))
    t = dedup.versions(t, "id", "title", "body", "known")
    docs = t.select("doc", "body", F.concat_ws(" ", "title", "body").alias("text"), "known")
    return dedup.near_duplicate_removal(docs)


@query("""
    select qa_id as id, answerable as question, answer as response, true as positive from augmented_qa
    union all select qa_id, unanswerable, 'Impossible to answer with given information', false from augmented_qa""")
def pos_neg_expand(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "answerable", "unanswerable", "answer")
    return curation.positive_negative(t, "qa_id", "answerable", "unanswerable", "answer")


@query("""
    with d as (select id, len(string_split(body, chr(10) || chr(10))) as m, row_number() over (order by id) - 1 as n, count(*) over () as total
               from (select id || '#' || row_number() over (partition by id order by body) as id, body from (select distinct id, body from cleaned_articles where body is not null))),
         s as (select id, n, total, unnest(range(0, 7 - m)) as slot from d where m < 7 and total > 1),
         x as (select id, slot::int as slot, (n + 1 + ('0x' || left(sha1(id || '|' || slot || '|noise'), 7))::bigint % (total - 1)) % total as n from s)
    select x.id, x.slot, d.id as other from x join d on d.n = x.n""")
def noise_draws(spark: SparkSession, folder: str) -> DataFrame:
    t = dedup.versions(load(spark, folder, "cleaned_articles", "id", "body").where("body is not null"), "id", "body", out="id")
    return curation.noise_draws(t, "id", F.size(F.split("body", "\n\n")))


@query("""
    with d as (select id || '#' || row_number() over (partition by id order by body, summary nulls first) as id, string_split(body, chr(10) || chr(10)) as chunks, summary as response
               from (select distinct id, body, summary from cleaned_articles where body is not null)),
         r as (select *, row_number() over (order by id) - 1 as n, count(*) over () as total from d),
         s as (select id, n, total, unnest(range(0, 7 - len(chunks))) as slot from r where len(chunks) < 7 and total > 1),
         x as (select s.id, o.chunks[('0x' || left(sha1(s.id || '|' || s.slot || '|noise-chunk'), 7))::bigint % len(o.chunks) + 1] as chunk
               from s join r o on o.n = (s.n + 1 + ('0x' || left(sha1(s.id || '|' || s.slot || '|noise'), 7))::bigint % (s.total - 1)) % s.total),
         l as (select id, list(chunk) as noise from x group by 1),
         p as (select id, n, total, unnest(range(1, 2 + ('0x' || left(sha1(id || '|noise-count'), 7))::bigint % 7)) as slot from r where ('0x' || left(sha1(id || '|noise-pure'), 7))::bigint < 0.1 * 268435456 and total > 1),
         y as (select p.id, p.slot, o.chunks[('0x' || left(sha1(p.id || '|' || p.slot || '|noise-pure-chunk'), 7))::bigint % len(o.chunks) + 1] as chunk
               from p join r o on o.n = (p.n + 1 + ('0x' || left(sha1(p.id || '|' || p.slot || '|noise-pure-other'), 7))::bigint % (p.total - 1)) % p.total)
    select id, 'og' as kind, array_to_string(list_transform(list_sort(list_transform(chunks[1:7], lambda x: {'h': sha1(x || 'og'), 'x': x})), lambda s: s.x), chr(10) || chr(10)) as body, response from r
    union all select r.id, 'aug', array_to_string(list_transform(list_sort(list_transform(list_concat(chunks[1:7], noise), lambda x: {'h': sha1(x || 'aug'), 'x': x})), lambda s: s.x), chr(10) || chr(10)), response from r join l using (id)
    union all select id, 'noise', string_agg(chunk, chr(10) || chr(10) order by slot), 'Impossible to answer with given information' from y group by 1""")
def noise_injection(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with their own chunks, padded with those of others, and of others only, with the summary as answer."""
    t = load(spark, folder, "cleaned_articles", "id", "body", "summary").where("body is not null")
    return curation.with_noise(dedup.versions(t, "id", "body", "summary", out="id"), "id", F.split("body", "\n\n"), answer=F.col("summary"))


@query("""
    with d as (select doc_id, row_number() over (order by doc_id) - 1 as n, (select max(doc_id) from documents) as top from documents where text is not null)
    select doc_id, 1.0::double as relevance from d union all select top + n + 1, 1.0::double from d""")
def aug_docs_qrels(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements of documents and of their rewritten copies."""
    d = load(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.col("text").alias("doc_text"))
    rels = d.select("doc_id", F.lit(1.0).alias("relevance"))
    return curation.augmented_docs(d, rels, F.upper("doc_text"))[1]


@query("""
    with d as (select doc_id, text, row_number() over (order by doc_id) as n, (select max(doc_id) from documents where text is not null) as top from documents where text is not null)
    select doc_id, text as doc_text from d union all select top + n, text || ' again' from d""")
def aug_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and their rewritten copies under new ids."""
    d = load(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.col("text").alias("doc_text"))
    return curation.augmented_docs(d, d.select("doc_id", F.lit(1.0).alias("relevance")), F.concat("doc_text", F.lit(" again")))[0]


@query("select json_object('input_text', answerable, 'output_text', answer)::varchar as value from augmented_qa where answer is not null and answerable is not null")
def jsonl_export(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "answerable", "answer").where("answer is not null and answerable is not null")
    return t.select(F.to_json(F.struct(F.col("answerable").alias("input_text"), F.col("answer").alias("output_text"))).alias("value"))


@query("""
    with y as (select coalesce(contains(lower(answer), 'impossible'), false) as t, coalesce(length(answer) < 45 and contains(answer, 'answer'), false) as p from augmented_qa),
         n as (select count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn from y),
         e as (select true as label, tp as t, fp as f, fn as m from n union all select false, tn, fn, fp from n),
         r as (select label, t + m as support, coalesce(t / nullif(t + f, 0), 0) as p, coalesce(t / nullif(t + m, 0), 0) as r from e)
    select label, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, support from r""")
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "answer")
    return evaluation.classification_report(t, F.lower("answer").contains("impossible"), (F.length("answer") < 45) & F.col("answer").contains("answer"))


def _rouge_sql(n: int) -> str:
    grams = lambda c: f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"
    return f"""
    with w as (select qa_id || '#' || row_number() over (partition by qa_id order by answerable nulls first, answer nulls first) as id, regexp_extract_all(lower(answerable), '[a-z0-9]+') as a, regexp_extract_all(lower(answer), '[a-z0-9]+') as b
               from (select distinct qa_id, answerable, answer from augmented_qa)),
         x as (select id, g, count(*) as n from (select id, unnest({grams('a')}) as g from w where len(a) >= {n}) group by 1, 2),
         y as (select id, g, count(*) as n from (select id, unnest({grams('b')}) as g from w where len(b) >= {n}) group by 1, 2),
         c as (select x.id, sum(least(x.n, y.n)) as c from x join y using (id, g) group by 1),
         r as (select w.id, coalesce(coalesce(c.c, 0) / nullif(greatest(len(b) - {n - 1}, 0), 0), 0) as p, coalesce(coalesce(c.c, 0) / nullif(greatest(len(a) - {n - 1}, 0), 0), 0) as r from w left join c using (id))
    select id, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from r"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "augmented_qa", "qa_id", "answerable", "answer")
    return dedup.versions(t, "qa_id", "answerable", "answer", out="qa_id")


@query(_rouge_sql(1))
def rouge_1(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.rouge_n(_pairs(spark, folder), "qa_id", "answerable", "answer", 1)


@query(_rouge_sql(2))
def rouge_2(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.rouge_n(_pairs(spark, folder), "qa_id", "answerable", "answer", 2)


@query("""
    with w as (select qa_id || '#' || row_number() over (partition by qa_id order by answerable nulls first, answer nulls first) as id,
                      regexp_extract_all(lower(coalesce(answerable, '')), '[a-z0-9]+') as a, regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+') as b
               from (select distinct qa_id, answerable, answer from augmented_qa)),
         e as (select id, len(a) as na, len(b) as nb, list_transform(a, lambda x: list_transform(b, lambda y: (y = x)::int)) as same, list_transform(b, lambda y: 0) as zero from w),
         c as (select id, na, nb, coalesce(list_max(list_reduce(same, lambda row, eq: list_transform(range(1, len(row) + 1), lambda j: list_max(list_transform(range(1, j + 1),
                      lambda k: case when eq[k] = 1 then coalesce(row[k - 1], 0) + 1 else row[k] end))), zero)), 0) as c from e),
         r as (select id, coalesce(c / nullif(nb, 0), 0) as p, coalesce(c / nullif(na, 0), 0) as r from c)
    select id, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from r""")
def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.rouge_l(_pairs(spark, folder), "qa_id", "answerable", "answer")


@query()
def rouge_lsum(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries against the beginning of their articles, line by line."""
    t = load(spark, folder, "cleaned_articles", "id", "summary", "title", "body").where("summary is not null and body is not null")
    t = dedup.versions(t, "id", "summary", "title", "body", out="id")
    return evaluation.rouge_lsum(t.withColumn("lead", F.concat_ws("\n", "title", F.substring_index("body", "\n\n", 2))), "id", "summary", "lead")


@query("""
    with t as (select distinct t.topic, t.topic_prob as prob, c.id, c.title from article_topic t join (select id, min(title) as title from cleaned_articles group by id) c on c.id = t.article_id
               where t.model = (select id from topic_model order by fit_date desc, id limit 1) and t.topic_prob is not null and c.title is not null),
         n as (select *, len(string_split('Title: ' || title, ' ')) as n from t),
         b as (select *, coalesce(sum(n) over (partition by topic order by prob desc, id rows between unbounded preceding and 1 preceding), 0) as before from n)
    select topic, count(*) as n_titles, sum(n)::bigint as n_tokens, string_agg('Title: ' || title, chr(10) order by prob desc, id) as text from b where before <= 60 group by topic""")
def topic_title_pack(spark: SparkSession, folder: str) -> DataFrame:
    newest = topics.latest_model(load(spark, folder, "topic_model")).select(F.col("id").alias("model"))
    a = load(spark, folder, "article_topic", "article_id", "model", "topic", "topic_prob").where("topic_prob is not null").join(F.broadcast(newest), "model")  # one row
    c = load(spark, folder, "cleaned_articles", "id", "title").groupBy("id").agg(F.min("title").alias("title")).where("title is not null")
    t = a.join(c, a["article_id"] == c["id"]).select("topic", F.col("topic_prob").alias("prob"), "id", "title").distinct()
    return topics.packed_titles(t, 60)


@query("""
    with w as (select category as cls, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents where category is not null and text is not null),
         f as (select * from w where term not in ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'from', 'has', 'have', 'he', 'her', 'his', 'if', 'in', 'into', 'is', 'it', 'its', 'no', 'not', 'of', 'on', 'or', 'our', 'she', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'we', 'were', 'which', 'will', 'with', 'you')),
         n as (select cls, term, count(*) as n from f group by 1, 2), c as (select cls, sum(n) as total from n group by 1), t as (select term, sum(n) as f from n group by 1),
         s as (select n.cls, n.term, n.n / c.total * ln(1 + (select avg(total) from c) / t.f) as weight from n join c using (cls) join t using (term))
    select cls, term, round(weight, 6) as weight from (select *, row_number() over (partition by cls order by round(weight, 9) desc, term) as r from s) where r <= 10""")
def ctfidf_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    d = load(spark, folder, "documents", "category", "text").where("category is not null and text is not null")
    w = topics.class_term_weights(d.select(F.col("category").alias("cls"), F.explode(T.word_tokens(F.col("text"))).alias("term")))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.round("weight", 9).desc(), "term"))
    return w.withColumn("r", rank).where("r <= 10").select("cls", "term", F.round("weight", 6).alias("weight"))


@query("""
    with u as (select url, row_number() over (order by url) as n from (select distinct url from scraped_articles where url is not null))
    select url, lower(regexp_extract(url, '^https?://(?:www\\.)?([^/:?#]+)', 1)) as host from u""")
def page_hosts(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "scraped_articles", "url").where("url is not null").distinct()
    return t.select("url", F.lower(F.regexp_extract("url", r"^https?://(?:www\.)?([^/:?#]+)", 1)).alias("host"))


@query("""
    with a as (select url from incoming_articles union all select url from cleaned_articles),
         u as (select url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') as rest from a where url is not null),
         h as (select url, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '\\.(:|$)', '\\1') as host,
                      regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path, regexp_extract(rest, '\\?(.*)$', 1) as q from u),
         k as (select url, case when regexp_matches(host, '^(www[0-9]?|m)\\.[^.]+\\.') then regexp_replace(host, '^(www[0-9]?|m)\\.', '') else host end as host, path,
                      list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' and not regexp_matches(lower(split_part(p, '=', 1)),
                          '^(utm_[a-z0-9_]+|fbclid|gclid|gclsrc|dclid|msclkid|yclid|mc_cid|mc_eid|igshid|twclid|ttclid|wbraid|gbraid|_ga|_gl|ref|ref_src|referrer|cmpid|icid|ncid|ocid|smid|spm|share|source_id|campaign_id|ito|partner)$'))) as p from h),
         c as (select url, host || path || case when len(p) > 0 then '?' || array_to_string(p, '&') else '' end as page from k)
    select page, count(*) as n, count(distinct url) as addresses from c group by 1 having count(distinct url) > 1""")
def canonical_pages(spark: SparkSession, folder: str) -> DataFrame:
    """How many articles each page has under its different addresses, where there are several."""
    t = load(spark, folder, "incoming_articles", "url").union(load(spark, folder, "cleaned_articles", "url")).where("url is not null")
    g = t.groupBy(canonical_url(F.col("url")).alias("page")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("addresses"))
    return g.where("addresses > 1")
