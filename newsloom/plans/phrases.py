"""Queries on lists, templates, budgets and blocks of text. SQL here spells its values out and shares none with the code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.catalog import load
from newsloom.functions import text as T
from newsloom.operators import blocks, english

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select id, trim(replace(replace(summary, '*', ' '), chr(10), ' ')) as text from cleaned_articles where regexp_matches(summary, '^[*\\s]*$') union all select id, regexp_replace(summary, '\\*\\s*\\*', '  *', 'g') from cleaned_articles where not regexp_matches(summary, '^[*\\s]*$') and not regexp_matches(summary, '\\*\\s*\\*\\s*\\*')")
def empty_bullets(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries without bullets that hold nothing."""
    t = load(spark, folder, "cleaned_articles", "id", "summary").where("summary is not null")
    clean = T.clean_bullets(F.col("summary"))
    blank = F.col("summary").rlike(r"^[*\s]*$")
    return t.where(blank | ~F.col("summary").rlike(r"\*\s*\*\s*\*")).select("id", F.when(blank, F.trim(F.replace(F.replace("summary", F.lit("*"), F.lit(" ")), F.lit("\n"), F.lit(" ")))).otherwise(F.regexp_replace(clean, r" (?=\*)", "  ")).alias("text"))


@query("""
    select id, unnest(list_filter(list_transform(string_split(title, ','), lambda x: trim(x)), lambda x: x <> '')) as item from cleaned_articles where title is not null""")
def comma_list(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "title").where("title is not null")
    return t.select("id", F.explode(T.comma_items(F.col("title"))).alias("item"))


_POINTS = "select id, list_filter(list_transform(string_split(summary, chr(10)), lambda x: regexp_replace(x, '^\\* ', '')), lambda x: x <> '') as p from cleaned_articles where summary_type = 'BULLETS' and summary is not null"


@query(f"with p as ({_POINTS}) select id, unnest(p) as item from p")
def numbered_list(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets written as a numbered list and read back from it."""
    t = load(spark, folder, "cleaned_articles", "id", "summary", "summary_type").where("summary_type = 'BULLETS' and summary is not null")
    points = F.filter(F.transform(F.split("summary", "\n"), lambda x: F.regexp_replace(x, r"^\* ", "")), lambda x: x != "")
    listed = F.array_join(F.transform(points, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return t.select("id", F.explode(T.numbered_items(listed)).alias("item"))


@query(f"with p as ({_POINTS}) select id, unnest(p) as item from p")
def json_list(spark: SparkSession, folder: str) -> DataFrame:
    """A model's answer in JSON, with text around it, read by its schema."""
    t = load(spark, folder, "cleaned_articles", "id", "summary", "summary_type").where("summary_type = 'BULLETS' and summary is not null")
    points = F.filter(F.transform(F.split("summary", "\n"), lambda x: F.regexp_replace(x, r"^\* ", "")), lambda x: x != "")
    said = F.concat(F.lit("Here is the result:\n"), F.to_json(F.struct(points.alias("points"))), F.lit("\nDone."))
    return t.select("id", F.explode(T.json_object(said, "points array<string>")["points"]).alias("item"))


@query("""
    with t as (select id, regexp_replace(title, '([.!?])\\s+', '\\1' || chr(1), 'g') as t from cleaned_articles where title is not null)
    select id, unnest(list_filter(string_split(t, chr(1)), lambda x: trim(x) <> '')) as sentence from t""")
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "title").where("title is not null")
    return t.select("id", F.explode(T.sentences(F.col("title"))).alias("sentence"))


@query("""
    with q as (select qa_id, answerable, answer, context, 64 - len(string_split('Question: ' || answerable || ' Answer: ' || answer, ' ')) - 8 as room
               from augmented_qa where answerable is not null and answer is not null and context is not null)
    select qa_id, array_to_string(string_split(context, ' ')[1:greatest(room, 0)], ' ') as context from q""")
def token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts cut to what a prompt of 64 tokens leaves, less a buffer of 8."""
    t = load(spark, folder, "augmented_qa", "qa_id", "answerable", "answer", "context").where("answerable is not null and answer is not null and context is not null")
    prompt = F.concat(F.lit("Question: "), "answerable", F.lit(" Answer: "), "answer")
    return t.select("qa_id", T.within_budget(F.col("context"), prompt, 64, 8).alias("context"))


@query("select qa_id, substr(answer, 3, greatest(length(answer) - 4, 0)) as answer from augmented_qa where answer is not null")
def fixed_slice(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "augmented_qa", "qa_id", "answer").where("answer is not null").select("qa_id", T.inner_slice(F.col("answer"), 2).alias("answer"))


@query("select id, trim(title) || chr(10) || trim(summary) as text from cleaned_articles where title is not null and summary is not null and summary_type = 'PLAIN'")
def headline_prepend(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "cleaned_articles", "id", "title", "summary", "summary_type").where("title is not null and summary is not null and summary_type = 'PLAIN'")
    return t.select("id", F.concat(F.trim("title"), F.lit("\n"), F.trim("summary")).alias("text"))


@query("""
    select qa_id, '[INST] <<SYS>>' || chr(10) || 'Answer from the context.' || chr(10) || '<</SYS>>' || chr(10) || answerable || ' [/INST] ' || answer
                  || case when ends_with(answer, '</s>') then '' else '</s>' end as text
    from augmented_qa where answerable is not null and answer is not null""")
def chat_template(spark: SparkSession, folder: str) -> DataFrame:
    """Turns in a chat template, without the mark of the beginning, with that of the end once."""
    t = load(spark, folder, "augmented_qa", "qa_id", "answerable", "answer").where("answerable is not null and answer is not null")
    text = T.chat(F.lit("Answer from the context."), F.col("answerable"), F.col("answer"))
    return t.select("qa_id", T.ended(F.concat(F.lit("<s>"), text), "<s>", "</s>").alias("text"))


@query("""
    select qa_id, context, answerable as question from augmented_qa
    where context is not null and answerable is not null and context <> '' and not contains(context, 'Question:') and trim(context) = context and trim(answerable) = answerable and answerable <> ''""")
def context_question(spark: SparkSession, folder: str) -> DataFrame:
    """Context and question taken out of a written prompt by its markers."""
    t = load(spark, folder, "augmented_qa", "qa_id", "context", "answerable").where(
        "context is not null and answerable is not null and context <> '' and not contains(context, 'Question:') and trim(context) = context and trim(answerable) = answerable and answerable <> ''"
    )
    prompt = F.concat(F.lit("Please answer.\nContext: "), "context", F.lit("\nQuestion: "), "answerable", F.lit("\nAnswer:"))
    return t.select("qa_id", T.between(prompt, "Context:", "Question:").alias("context"), T.between(prompt, "Question:", "Answer:").alias("question"))


@query("select article_id, string_agg(answer, chr(10) order by qa_id) as joined from (select distinct article_id, qa_id, answer from augmented_qa where article_id is not null and answer is not null) group by 1")
def references_join(spark: SparkSession, folder: str) -> DataFrame:
    """An article's answers as one text, a line each: groups as small as an article's questions."""
    t = load(spark, folder, "augmented_qa", "article_id", "qa_id", "answer").where("article_id is not null and answer is not null").distinct()
    rows = F.array_sort(F.collect_list(F.struct("qa_id", "answer")))
    return t.groupBy("article_id").agg(F.array_join(F.transform(rows, lambda r: r["answer"]), "\n").alias("joined"))


@query("select n_nationkey as key, n_name as name from nation")
def positional_rename(spark: SparkSession, folder: str) -> DataFrame:
    """Columns named by position, those behind dropped."""
    t = load(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey")
    return t.toDF("key", "name", "last").drop("last")


@query("select doc_id from documents where coalesce(contains(text, 'percent') and not regexp_matches(text, '[0-9]{3}'), false)")
def relevant_not_stat(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "documents", "doc_id", "text").select("doc_id", F.col("text").contains("percent").alias("relevant"), F.col("text").rlike("[0-9]{3}").alias("stat"))
    return t.where("relevant and not stat").select("doc_id")


@query("select qa_id from augmented_qa where contains(lower(answer), 'impossible') = (length(answer) < 45) and not (not contains(lower(answer), 'answer'))")
def equal_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose label is the predicted one, of those that do not lack a word."""
    t = load(spark, folder, "augmented_qa", "qa_id", "answer")
    y, y_hat = F.lower("answer").contains("impossible"), F.length("answer") < 45
    return t.where((y == y_hat) & ~(~F.lower("answer").contains("answer"))).select("qa_id")


@query("""
    with g as (select user_id, event_type, ts, lead(ts) over (partition by user_id order by ts, event_id) as next, value from events)
    select event_type, round(avg((epoch_us(next) - epoch_us(ts)) / 1000.0 / value), 4) as ms_per_token from g where next is not null and value > 0 group by 1""")
def ms_per_token(spark: SparkSession, folder: str) -> DataFrame:
    """Milliseconds between a user's events by the tokens of the first, on average by kind."""
    from pyspark.sql import Window

    t = load(spark, folder, "events", "event_id", "user_id", "event_type", "ts", "value")
    t = t.withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next is not null and value > 0")
    ms = (F.unix_micros(F.col("next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000.0 / F.col("value")
    return t.groupBy("event_type").agg(F.round(F.avg(ms), 4).alias("ms_per_token"))


_H1 = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&#39;', '''', 'g'), '\\s+', ' ', 'g'))"


@query(f"select distinct id, '## ' || {_H1} as heading from scraped_articles where html is not null and len(regexp_extract_all({_H1}, '[\\p{{L}}\\p{{N}}]+')) >= 3 and not contains({_H1}, '|') and not contains({_H1}, '&')")
def typed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as typed blocks; titles of three words or more and without a bar, as headings."""
    t = load(spark, folder, "scraped_articles", "id", "html").where("html is not null").distinct()
    b = blocks.typed_blocks(t, "id", "html").where(blocks.worth_keeping(F.col("kind"), F.col("text")) & (F.col("tag") == "h1"))
    return b.where(~F.col("text").contains("&")).select("id", blocks.heading(F.col("kind"), F.col("text")).alias("heading")).distinct()


@query()
def assembled_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies put together from the blocks that are titles or narrative, with headings marked."""
    t = load(spark, folder, "scraped_articles", "id", "html").where("html is not null").distinct()
    return blocks.assembled(blocks.typed_blocks(t, "id", "html"))


@query("""
    select distinct id, nullif(regexp_extract(html, '<meta name="article:published_time" content="([^"]*)"', 1), '') as published,
           nullif(trim(regexp_replace(regexp_extract(html, '(?s)<p class="?(?:meta|note)"?>(By [^<]*)</p>', 1), '\\s+', ' ', 'g')), '') as byline
    from scraped_articles where html is not null and regexp_matches(html, '(?s)<p class="?(?:meta|note)"?>By [^<]*</p>')""")
def class_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes and texts by meta name and by class."""
    t = load(spark, folder, "scraped_articles", "id", "html").where("html is not null").distinct()
    by = blocks.first_by_class(F.col("html"), "p", ("meta", "note"), r"By ")
    stamp = blocks.attribute(F.col("html"), "meta", "name", "article:published_time", "content")
    return t.select("id", stamp.alias("published"), by.alias("byline")).where("byline is not null").distinct()


@query()
def stemmed_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of a question with its context by stems, without stop words, from 0.03 on."""
    t = load(spark, folder, "augmented_qa", "qa_id", "answerable", "context").where("answerable is not null and context is not null").distinct()
    return english.relevance(t, "qa_id", "answerable", "context", 0.03)
