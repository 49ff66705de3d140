import statistics

import pytest
from pyspark.sql import functions as F

from newsloom.functions import quantiles
from newsloom.operators import blocks, coref, curation, dedup, english, evaluation, generation, language_tools, market, retrieval, topics, web
from newsloom.session import shared_path
from newsloom.sources import tables
from newsloom.streaming import news


@pytest.mark.parametrize("partitions", ["3", "50"])
def test_numbering_wide_rows_loses_none(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.range(20_000).select(F.xxhash64("id").alias("doc_id"), F.repeat(F.lit("wide text "), (F.col("id") % 40).cast("int")).alias("doc_text"))
        got = curation.numbered(docs, "doc_id").agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.countDistinct("doc_id")).first()
        assert tuple(got) == (20_000, 20_000, 0, 19_999, 20_000)
        rels = docs.select(F.lit(1).alias("query_id"), "doc_id")
        new, judged = curation.augmented_docs(docs, rels, F.upper("doc_text"))
        assert new.count() == judged.count() == 40_000 and judged.join(new, "doc_id", "left_anti").count() == 0
        out = shared_path(spark, "numbered")
        curation.numbered(docs, "doc_id").write.parquet(out)
        assert spark.read.parquet(out).select("n").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbering_counts_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (None, "n")], "id int, n0 string")
    assert [r["n"] for r in curation.numbered(docs, "id").orderBy("n").collect()] == [0, 1, 2, 3]
    assert curation.numbered(docs.limit(0), "id").count() == 0


def test_exact_quantiles(spark):
    values = [(k, v) for k, n in (("a", 1000), ("b", 1), ("c", 7)) for v in ([3.0] * (n // 2) + [i * 1.7 % 11 for i in range(n - n // 2)])]
    df = spark.createDataFrame([*values, ("a", None), ("d", None)], "k string, v double")
    got = {r["k"]: (r["p0"], r["p1"], r["p2"]) for r in quantiles.exact(df, "k", "v", (0.25, 0.5, 0.75)).collect()}
    for k in "abc":
        x = [v for g, v in values if g == k]
        want = statistics.quantiles(x, n=4, method="inclusive") if len(x) > 1 else [x[0]] * 3
        assert got[k] == pytest.approx(want)
    assert "d" not in got and quantiles.exact(df.limit(0), "k", "v", (0.5,)).count() == 0


def test_nearest_keeps_every_tie_in_order(spark):
    rows = [(i, [1.0, 0.0] if i < 20 else [0.0, 1.0]) for i in range(25)] + [(30, None), (31, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "doc_id long, dv array<double>").withColumn("g", F.col("doc_id") % 2)
    q = spark.createDataFrame([(0, [2.0, 0.0]), (7, None), (8, [0.0, 0.0])], "query_id long, qv array<double>")
    got = sorted((r["rank"], r["doc_id"]) for r in retrieval.nearest(q, d.drop("g"), 8).collect())
    assert got == [(i, i) for i in range(1, 9)]
    assert {(r["g"], r["rank"], r["doc_id"]) for r in retrieval.nearest(q, d, 2, group="g").collect()} == {(0, 1, 2), (0, 2, 4), (1, 1, 1), (1, 2, 3)}
    assert retrieval.nearest(q.limit(0), d, 3).count() == 0


def test_links_are_resolved_as_urljoin_does(spark):
    from urllib.parse import urljoin

    base = "https://a.example/x/y/page.html?q=1"
    found = ["/p", "z.html", "../u", "../../../far", "./here/", "//cdn.example/q", "https://b.example/", "?n=2", "mailto:a@b.c", "a/../b", "..", "z?x=1"]
    html = "".join(f"<a class=k href='{x}'>l</a>" if i % 2 else f'<a href="{x}" id=1>l</a>' for i, x in enumerate(found)) + "<a href=/bare>x</a><a name=n>no</a>"
    got = spark.createDataFrame([(html, base)], "h string, u string").select(web.links(F.col("h"), F.col("u")).alias("l")).first()["l"]
    strip = lambda x: x[:-1] if x.endswith(("#", "/")) else x
    assert set(got) == {strip(urljoin(base, x)) for x in [*found, "/bare"]}


def test_porter_stems():
    said = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
        "conditional": "condit", "vietnamization": "vietnam", "operator": "oper", "decisiveness": "decis", "hopefulness": "hope", "triplicate": "triplic", "formalize": "formal",
        "electrical": "electr", "goodness": "good", "revival": "reviv", "inference": "infer", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect",
        "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "by": "by",
    }
    assert {w: english.stem(w) for w in said} == said


def test_relevance_by_stems(spark):
    df = spark.createDataFrame([(1, "rising profits", "The profit rises."), (2, "the of", "and"), (3, None, "x"), (4, "bank", "shares")], "id int, a string, b string")
    assert {r["id"]: r["similarity"] for r in english.relevance(df, "id", "a", "b", 0.03).collect()} == {1: pytest.approx(1.0)}


def test_blocks(spark):
    html = "<html><head><title>t</title></head><body><script>x()</script><h2>A  long &amp; good title</h2><p>One is here.<p>Two | bars here.<ul><li>An item</li></ul><div>no end</div></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    got = blocks.typed_blocks(df, "id", "html")
    assert [(r["tag"], r["kind"], r["text"]) for r in got.orderBy("n").collect()] == [
        ("h2", "Title", "A long & good title"), ("p", "NarrativeText", "One is here."), ("p", "NarrativeText", "Two | bars here."), ("li", "ListItem", "An item"), ("div", "UncategorizedText", "no end"),
    ]
    assert blocks.assembled(got).first()["body"] == "## A long & good title\n\nOne is here."


def test_references_by_first_mention_and_by_window(spark):
    tokens, tags, spaces = ["He", "saw", "the", "man", "he", "knew"], ["PRP", "X", "X", "NOUN", "PRP", "X"], [" "] * 5 + [""]
    clusters = [[[0, 0], [2, 4]], [[4, 4], [0, 0]]]
    assert language_tools.rewrite_references(tokens, tags, spaces, clusters[:1], first_mention=True) == "He saw He knew"
    text = "Ann Abel left. She said it was her plan. Bert Brown knows what he did."
    assert coref.rewritten(text) == "Ann Abel left. Ann Abel said Ann Abel was Ann Abel's plan. Bert Brown knows what Bert Brown did."
    assert coref.rewritten_by_window(text) == coref.rewritten(text)
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "x")], "id int, body string")
    broken = lambda t: 1 / 0 if t == "x" else t
    assert {r["id"] for r in coref.resolved(df, "id", "body", broken).collect()} == {1}


def test_retries_wait_longer_and_give_up():
    waited, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 4:
            raise TimeoutError("busy")
        return x

    assert generation.retried(call, "a", sleep=waited.append, seed=1) == "a" and len(waited) == 3
    assert all(0.8 * 2**i <= w <= 1.2 * 2**i for i, w in enumerate(waited))
    with pytest.raises(ZeroDivisionError):
        generation.retried(lambda: 1 / 0, tries=2, sleep=waited.append)


def test_few_shot_keeps_to_the_budget(spark):
    df = spark.createDataFrame([(["a b c", "d e f g h", "i"], "task x")], "e array<string>, t string")
    assert df.select(generation.few_shot(F.col("e"), F.col("t"), 6).alias("p")).first()["p"] == "a b c\n\ni\n\ntask x"


def test_figures_of_companies(spark):
    rows = [("A", '{"x": {"marketCap": 1, "trailingPE": {"raw": 3}}, "y": {"marketCap": {"raw": 7}, "priceToBook": {}}}'), ("B", '{"x": {"marketCap": 0}}'), ("C", "broken"), ("D", None)]
    held = market.figures(spark.createDataFrame(rows, "id string, json string"), "id", "json", ["x", "y"])
    assert {(r["id"], r["key"], r["value"]) for r in held.collect()} == {("A", "marketCap", "7"), ("A", "trailingPE", "3"), ("B", "marketCap", "0")}
    assert {(r["id"], r["label"], r["value"]) for r in market.grouped(market.with_capital(held)).collect()} == {("A", "Market Cap($)", "7"), ("A", "P/E", "3")}


def test_topic_model_is_saved_and_assigns_unseen_rows(spark):
    rows = [(i, [float(10 * (i % 3)) + (i % 7) / 10] * 4 + [float(i % 5) / 10]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    path = shared_path(spark, "model")
    topics.fit(df, "v", k=3, components=2).save(path)
    new = spark.createDataFrame([(1000 + i, [float(10 * i)] * 4 + [0.2]) for i in range(3)] + [(1, None), (2, [500.0] * 5)], "id long, v array<double>")
    got = {r["id"]: r["topic"] for r in topics.TopicModel.load(spark, path).assign(new, "id", "v").collect()}
    assert len({got[1000], got[1001], got[1002]}) == 3 and -1 not in {got[1000], got[1001], got[1002]} and got[1] == got[2] == -1


def test_first_of_both(spark):
    rows = [("g", 1, "u1", "t1"), ("g", 2, "u1", "t2"), ("g", 3, "u2", "t2"), ("g", 4, "u3", "t1"), ("g", 5, "u2", "t9"), ("h", 1, "u1", "t1")]
    df = spark.createDataFrame(rows, "g string, n int, u string, t string")
    assert {(r["g"], r["n"]) for r in language_tools.first_of_both(df, ["g"], "n", "u", "t").collect()} == {("g", 1), ("g", 3), ("h", 1)}


def test_versions_appear_with_their_marker(spark, tmp_path):
    at, df = str(tmp_path / "v"), spark.createDataFrame([(1,)], "x int")
    assert tables.read_together(spark, at, "a", "x int").count() == 0
    tables.write_together({"a": df, "b": df}, at, "one")
    df.write.parquet(f"{at}/a/two")
    assert tables.read_together(spark, at, "a", "x int").count() == 1
    ids = tables.with_key(df, F.col("x").cast("string")).first()["id"]
    assert ids == tables.with_key(df.repartition(3), F.col("x").cast("string")).first()["id"] and len(ids) == 36


def test_documents_with_and_without_index(spark, tmp_path):
    at, df = str(tmp_path / "d"), spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, x int")
    tables.write_json_documents(df, at, "key")
    df.where("x = 1").withColumn("key", F.lit("k3")).write.mode("append").partitionBy("key").json(at)  # not in the index
    assert {r["key"] for r in tables.read_json_documents(spark, at, "x int", "key").collect()} == {"k1", "k2"}
    import shutil

    shutil.rmtree(f"{at}_index")
    assert {r["key"] for r in tables.read_json_documents(spark, at, "x int", "key").collect()} == {"k1", "k2", "k3"}


def test_late_rows_are_dropped(spark, tmp_path):
    """Windows are given out once, when the watermark has passed them; a row older than that is not counted."""
    at = str(tmp_path / "in")
    for n, days in enumerate((["2024-01-01 00:10:00", "2024-01-01 00:20:00"], ["2024-01-20 00:00:00"], ["2024-01-20 00:01:00"], ["2024-01-01 00:30:00", "2024-01-20 00:05:00"], ["2024-02-20 00:00:00"], ["2024-02-20 01:00:00"])):
        rows = spark.createDataFrame([(d, "k") for d in days], "t string, k string").select(F.to_timestamp("t").alias("ts"), "k")
        rows.coalesce(1).write.parquet(f"{at}/{n}")
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)
    got = news.run_to(news.windowed_counts(stream, "ts", "k", late="5 days"), str(tmp_path / "out")).collect()
    assert {(r["start"].strftime("%m-%d"), r["n"]) for r in got} == {("01-01", 2), ("01-20", 3)}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from newsloom import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_slices_are_repeated_and_forgotten():
    now, seen = [0.0], []

    def step(known):
        seen.append(known)
        now[0] += 10
        return (known or 0) + 1

    assert news.crawl_slices(step, 0, 30, lambda: len(seen) >= 7, lambda: now[0]) == 7
    assert seen == [None, 1, 2, None, 1, 2, None]


def test_rules_of_robots(spark):
    links = spark.createDataFrame([(x,) for x in ("https://a.example", "https://a.example/p/1", "https://a.example/p/open/2", "https://b.example/p/1")], "link string")
    rules = spark.createDataFrame([("A.example", "/p/", False), ("a.example", "/p/open", True), ("a.example", "/p/open", False)], "host string, prefix string, allow boolean")
    got = {r["link"] for r in web.permitted(links, rules).collect()}
    assert got == {"https://a.example", "https://a.example/p/open/2", "https://b.example/p/1"}


def test_rouge_by_lines_and_longest_common():
    import random

    rng = random.Random(1)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert evaluation.longest_common(a, b) == brute(a, b) == len(evaluation.union_of_common(a, [b]))


def test_rouge_lsum(spark):
    df = spark.createDataFrame([(1, "a b c\nd e", "d e\na c"), (2, None, "x"), (3, "a a b", "a\na")], "id int, y string, p string")
    got = {r["id"]: (r["precision"], r["recall"]) for r in evaluation.rouge_lsum(df, "id", "y", "p").collect()}
    assert got == {1: (1.0, 0.8), 2: (0.0, 0.0), 3: (0.5, 0.333333)}


def test_bucket_pairs(spark):
    """Keys of one, two, equal and many members, the last in blocks; of numbers and of strings."""
    import random

    rng = random.Random(5)
    buckets = {0: {1}, 1: {1, 2}, 2: {1, 2}, 3: {3, 4, 5}, 4: {3, 4, 5}, **{k: {rng.randrange(-40, 40) for _ in range(rng.randrange(1, 25))} for k in range(10, 40)}}
    want = {(a, b) for m in buckets.values() for a in m for b in m if a < b}
    keys = spark.createDataFrame([(k, d) for k, m in buckets.items() for d in m], "key long, doc long")
    got = [(r["a"], r["b"]) for r in dedup.bucket_pairs(keys, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    named = {(r["a"], r["b"]) for r in dedup.bucket_pairs(keys.withColumn("doc", F.col("doc").cast("string")), 3).collect()}
    assert named == {tuple(sorted((str(a), str(b)))) for a, b in want}
    assert dedup.bucket_pairs(keys.limit(0)).count() == 0


def _articles(folder, copies=1):
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(f"a{i:02d}", f"Grain price {('up', 'down')[i % 2]} in port {i % 5}", f"Grain and wheat {'wheat ' * (i % 4)}prices at port {i % 3}. " + "İt rose. " * (i % 2)) for i in range(30)]
    rows += [("a01", "Second grain version", "wheat"), ("a02", None, "port"), ("b", "Grain", None), ("c", "—", "…")]
    pq.write_table(pa.table(dict(zip(("id", "title", "body"), map(list, zip(*rows))))), f"{folder}/cleaned_articles.parquet")
    asked = [(0, "Wheat and grain at the port"), (50, "the of"), (100, None), (150, "PORT 3 prices"), (151, "wheat")]
    asked = (asked + [(0, "grain, wheat!")]) * copies  # the same arrival twice adds its terms
    pq.write_table(pa.table({"arrival_no": pa.array([a for a, _ in asked], pa.int64()), "title": [t for _, t in asked], "at": [datetime.datetime(2024, 1, 1)] * len(asked)}), f"{folder}/incoming_articles.parquet")


def _by_sql(folder, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("cleaned_articles", "incoming_articles"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def _no_pairs(df):
    """Whether no pair of query and document is joined."""
    return "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_topk_scores_without_joining_pairs(spark, tmp_path):
    from newsloom.plans import search

    _articles(tmp_path)
    got = search.bm25_topk(spark, str(tmp_path))
    assert _no_pairs(got)
    assert sorted(map(tuple, got.collect())) == _by_sql(tmp_path, "bm25_topk") != []


def test_bm25_top_equals_the_ranks_of_all_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f, f"{'x ' * (i % 7 + 1)}y{i % 3} z") for i in range(90) for f in ("one", "two")] + [(90, "one", None), (91, "two", "!")], "doc_id long, field string, text string").repartition(3)
    queries = spark.createDataFrame([(q, f"x y{q % 3} the") for q in range(12)] + [(12, "none of it"), (13, None)], "query_id int, text string")
    want = retrieval.ranked(retrieval.bm25(docs, queries), ["query_id", "field"], F.round("score", 8), ["doc_id"], 4)
    want = {(*r[:3], r["rank"]) for r in want.select("query_id", "field", "doc_id", "rank").collect()}
    assert len(want) == 12 * 2 * 4
    for terms, kept, some in ((300_000, 250_000, 16_384), (10, 20, 8)):  # in one, in several blocks of queries and slices of texts
        monkeypatch.setattr(retrieval, "TERMS", terms)
        monkeypatch.setattr(retrieval, "KEPT", kept)
        monkeypatch.setattr(retrieval, "SLICE", some)
        got = retrieval.bm25_top(docs, queries, 4).select("query_id", "field", "doc_id", "rank").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert retrieval.bm25_top(docs, queries.limit(0), 4).count() == retrieval.bm25_top(docs.limit(0), queries, 4).count() == 0


def test_bm25_best_field_scores_without_joining_pairs(spark, tmp_path):
    from newsloom.plans import search

    _articles(tmp_path)
    got = search.bm25_best_field(spark, str(tmp_path))
    assert _no_pairs(got)
    assert sorted(map(tuple, got.collect())) == _by_sql(tmp_path, "bm25_best_field") != []


def test_hybrid_rrf_fuses_without_joining_pairs(spark, tmp_path):
    from newsloom.plans import search

    _articles(tmp_path)
    got = search.hybrid_rrf(spark, str(tmp_path))
    assert _no_pairs(got)
    assert sorted(map(tuple, got.collect())) == _by_sql(tmp_path, "hybrid_rrf") != []


def test_bm25_best_field_asks_for_every_arrival(spark, tmp_path):
    from newsloom.plans import search

    _articles(tmp_path)
    got = search.bm25_best_field(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == {0, 150, 151}  # 151 is no multiple of 50; 50 and 100 ask for nothing
    assert sorted(map(tuple, got)) == _by_sql(tmp_path, "bm25_best_field")


def test_bm25_top_by_parts_of_the_queries(spark, monkeypatch):
    """Queries in parts over all texts, frequent terms as rows, queries of the same terms, more texts than four times k."""
    docs = spark.createDataFrame([(f"d{i:03d}", f, f"{'x ' * (i % 7 + 1)}y{i % 3} z w{i % 50}") for i in range(400) for f in ("one", "two")], "doc_id string, field string, text string").repartition(3)
    queries = spark.createDataFrame([(q, f"x y{q % 3} w{q % 25}") for q in range(60)] + [(90, "w7 nothing"), (91, "nothing")], "query_id int, text string")
    want = retrieval.ranked(retrieval.bm25(docs, queries), ["query_id", "field"], F.round("score", 8), ["doc_id"], 5)
    want = sorted((*r[:3], r["rank"], round(r["score"], 6)) for r in want.select("query_id", "field", "doc_id", "rank", "score").collect())
    assert len(want) == 61 * 2 * 5
    monkeypatch.setattr(retrieval, "PART", 10)
    for hot, some in ((0, 10_000), (2, 130), (400, 60)):
        monkeypatch.setattr(retrieval, "HOT", hot)
        monkeypatch.setattr(retrieval, "SLICE", some)
        got = retrieval.bm25_top(docs, queries, 5).select("query_id", "field", "doc_id", "rank", "score").collect()
        assert sorted((*r[:4], round(r["score"], 6)) for r in got) == want


def test_hybrid_rrf_asks_for_every_arrival(spark, tmp_path):
    from newsloom.plans import search

    _articles(tmp_path)
    got = search.hybrid_rrf(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == {0, 150, 151}
    assert sorted(map(tuple, got)) == _by_sql(tmp_path, "hybrid_rrf")
