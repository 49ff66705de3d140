import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import curation, dedup, evaluation, language_tools, retrieval, topics, web
from newsloom.operators.graphs import connected_components
from newsloom.operators.urls import canonical_url
from newsloom.session import shared_path
from newsloom.sources import tables
from newsloom.streaming import news


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.normalize_text(F.lit(" a \t\r\nb "))) == "a b"
    assert one(spark, T.strip_intro(F.lit("NY - text - x"), F.lit("reuters"), "reuters")) == "text - x"
    assert one(spark, T.strip_intro(F.lit("no sign"), F.lit("reuters"), "reuters")) == "no sign"
    assert one(spark, T.strip_intro(F.lit("a - b"), F.lit("other"), "reuters")) == "a - b"
    assert one(spark, T.clean_bullets(F.lit("* \n* a"))) == " * a"
    long = "SUMMARY: " + "x" * 40_000
    assert one(spark, T.between(F.lit(long), "SUMMARY:")) == "x" * 40_000
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    for items, kind in (([], "BULLETS"), ([""], "NULL"), (["x"], "PLAIN"), (["", "x"], "BULLETS"), (["a", "b"], "BULLETS")):
        c = F.array(*map(F.lit, items)).cast("array<string>")
        assert one(spark, T.consolidate_summary(c))["summary_type"] == kind
    for ticker, forms in (("AAPL", ["AAPL"]), ("BRK.B", ["BRK.B", "BRK"]), ("", [])):
        assert one(spark, T.ticker_forms(F.lit(ticker))) == forms


def test_canonical_url(spark):
    same = [
        "https://www.a.example/x/1", "http://a.example:443/x/1/", "https://A.EXAMPLE/x/1#top", "https://m.a.example:80/x/1?utm_source=z&fbclid=1",
    ]
    assert {one(spark, canonical_url(F.lit(u))) for u in same} == {"a.example/x/1"}
    a, b = "https://a.example/s?id=1&section=x", "https://a.example/s/?section=x&id=1&ref=home"
    assert one(spark, canonical_url(F.lit(a))) == one(spark, canonical_url(F.lit(b))) == "a.example/s?id=1&section=x"
    assert one(spark, canonical_url(F.lit("https://a.example/X"))) != one(spark, canonical_url(F.lit("https://a.example/x")))
    assert one(spark, canonical_url(F.lit(" "))) is None


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in parent}
    got = dict(connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect())
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_removal(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, base, False), (2, base + " x", base + " x", False), (3, base, base, True), (4, "a b c", "a b c", False), (5, "d e f", "d e f", False), (6, "", "", False),
    ]
    df = spark.createDataFrame(rows, "doc long, body string, text string, known boolean")
    assert {r["doc"] for r in dedup.near_duplicate_removal(df).collect()} == {4, 5, 6}  # 1, 2 go with the known 3; short texts stay


def test_noise_and_augmentation(spark):
    docs = spark.createDataFrame([(i, [f"c{i}-{j}" for j in range(n)]) for i, n in enumerate((1, 6, 7, 9))], "id long, chunks array<string>")
    out = curation.with_noise(docs, "id", F.col("chunks")).collect()
    assert sorted((r["id"], r["kind"]) for r in out) == [(0, "aug"), (0, "og"), (1, "aug"), (1, "og"), (2, "og"), (3, "og")]
    for r in out:
        n = len(r["body"].split("\n\n"))
        assert n == (7 if r["kind"] == "aug" else min(7, (1, 6, 7, 9)[r["id"]]))
    lone = docs.where("id = 0")
    assert [r["kind"] for r in curation.with_noise(lone, "id", F.col("chunks")).collect()] == ["og"]
    d = spark.createDataFrame([(1, "a"), (5, "b")], "doc_id long, doc_text string")
    r = spark.createDataFrame([(9, 5, 1.0)], "query_id long, doc_id long, relevance double")
    ds, rs = curation.augmented_docs(d, r, F.upper("doc_text"))
    assert {tuple(x) for x in ds.collect()} == {(1, "a"), (5, "b"), (6, "A"), (7, "B")}
    assert sorted(x["doc_id"] for x in rs.collect()) == [5, 7]


def test_pure_noise(spark):
    """A tenth of the rows come again with 1 to 7 chunks of others only, and the answer that none is possible."""
    docs = spark.range(400).select("id", F.expr("transform(sequence(1, 1 + int(id % 9)), j -> concat('c', id, '-', j))").alias("chunks"), F.concat(F.lit("a"), "id").alias("answer"))
    out = curation.with_noise(docs, "id", F.col("chunks"), answer=F.col("answer")).collect()
    noise = [r for r in out if r["kind"] == "noise"]
    assert 20 < len(noise) < 60 and len({r["id"] for r in noise}) == len(noise)
    parts = [r["body"].split("\n\n") for r in noise]
    assert {len(p) for p in parts} == set(range(1, 8))
    assert all(x.split("-")[0] != f"c{r['id']}" for r, p in zip(noise, parts) for x in p)
    assert all(r["response"] == (T.IMPOSSIBLE if r["kind"] == "noise" else f"a{r['id']}") for r in out)


def test_fusion_and_mmr(spark):
    lists = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 2, 1), (0, 1, 3, 2)], "fusion_id long, list_no int, doc_id long, rank int")
    got = {r["doc_id"]: r["score"] for r in retrieval.rag_fusion(lists).collect()}
    want = {1: 2 / 61 + 1 / 160, 2: 2 / 62 + 1 / 61, 3: 2 / 160 + 1 / 62}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert [r["doc_id"] for r in retrieval.rag_fusion(lists, top=1).collect()] == [2]
    assert [r["doc_id"] for r in retrieval.rag_fusion(lists, top=1, worst_first=True).collect()] == [3]
    c = spark.createDataFrame([(0, 1, [1.0, 0.0], [1.0, 0.0]), (0, 2, [1.0, 0.0], [1.0, 0.01]), (0, 3, [1.0, 0.0], [0.6, 0.8])], "query_id long, doc_id long, qv array<double>, dv array<double>")
    picks = lambda w: [r["doc_id"] for r in retrieval.mmr(c, 3, w).orderBy("pick").collect()]
    assert picks(1.0) == [1, 2, 3] and picks(0.3) == [1, 3, 2]


def test_hybrid_retriever(spark):
    """The vector arm finds what has no keyword, and stands alone where the query has none; the filter is its own."""
    texts = {"a": "Acme Corp opens plant", "b": "rising wheat prices in spring", "c": "wheat prices in spring rising again", "d": "nothing of it"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    q = spark.createDataFrame([(1, "Acme Corp rising wheat prices"), (2, "rising wheat prices"), (3, "")], "query_id long, text string")
    fields = docs.select("doc_id", F.lit("body").alias("field"), "text")
    got = {}
    for r in retrieval.hybrid(q, docs.where("doc_id <> 'a'"), fields, fetch=2).orderBy("pick").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert set(got[1]) == {"a", "b"} and got[2] == ["b", "c"] and 3 not in got


def test_nearest_blocks_agree(spark):
    rng = random.Random(1)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)]
    q = spark.createDataFrame(v[:9], "query_id long, qv array<double>")
    d = spark.createDataFrame(v, "doc_id long, dv array<double>")
    whole = {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.nearest(q, d, 3).collect()}
    old, retrieval.BLOCK = retrieval.BLOCK, 4
    try:
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.nearest(q, d, 3).collect()} == whole
    finally:
        retrieval.BLOCK = old


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, None, "x"), (3, "", "")], "id long, a string, b string")
    got = {r["id"]: r for r in evaluation.rouge_l(df, "id", "a", "b").collect()}
    assert round(got[1]["f1"], 4) == 0.6667 and got[2]["f1"] == 0.0 and got[3]["f1"] == 0.0
    n = {r["id"]: r["f1"] for r in evaluation.rouge_n(df, "id", "a", "b", 2).collect()}
    assert n[1] == 0.5 and n[2] == 0.0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(20, 60), st.integers(0, 15))
def test_sentence_packing(sizes, size, overlap):
    s = [" ".join(f"s{i}w{j}" for j in range(n - 1)) + f" end{i}." for i, n in enumerate(sizes)]
    chunks = language_tools.pack_sentences(" ".join(s), size, overlap)
    for x in s:
        assert any(x.strip() in c for c in chunks)
    assert all(len(c.split()) <= size or len(c.split()) in sizes for c in chunks)


def test_references_and_cover():
    tokens, tags, spaces = ["Ann", "said", "her", "firm", "grew", "."], ["NNP", "VBD", "PRP$", "NN", "VBD", "."], [" ", " ", " ", " ", "", ""]
    assert language_tools.rewrite_references(tokens, tags, spaces, [[[0, 0], [2, 2]]]) == "Ann said Ann's firm grew."
    assert language_tools.rewrite_references(tokens, tags, spaces, [[[2, 2]]]) == "Ann said her firm grew."
    assert language_tools.cover([5, 5, 5], [({0, 1}, 1.0), ({2}, 0.9)], 11) == [0, 2]
    assert language_tools.cover([0, 4], [], 10) == [0, 1]


def test_web_registry_and_frontier(spark):
    html = '<html><head><meta name="article:published_time" content="x"></head><body><h1>A <b>b</b></h1><a href="/p/">1</a><a href="https://o.example/q#">2</a></body></html>'
    df = spark.createDataFrame([("https://s.example/a", html), ("https://s.example/b", "<p>no headline</p>")], "url string, html string")
    got = web.NEWS.extract(df).collect()
    assert [(r["headline"], r["stamp"]) for r in got] == [("A b", "x")]
    seen = spark.createDataFrame([("https://o.example/q",)], "link string")
    assert [r["link"] for r in web.frontier(df, seen).collect()] == ["https://s.example/p"]


def test_sources_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, None)], "id long, x string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "c"), "id long, x string").collect()} == {(1, 'a,"b"\nc'), (2, None)}
    tables.write_jsonl(df, str(tmp_path / "j"), "id", "x")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    tables.write_together({"a": df, "b": df}, str(tmp_path / "t"), "one")
    assert spark.read.json(str(tmp_path / "t" / "_committed")).count() == 1
    new = spark.createDataFrame([(2, "new"), (3, "more")], "id long, x string")
    assert {tuple(r) for r in tables.upsert(df, new, ["id"]).collect()} == {(1, 'a,"b"\nc'), (2, "new"), (3, "more")}
    for i in range(2):
        spark.createDataFrame([("u1",), (f"v{i}",)], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    check, out = shared_path(spark, "check"), shared_path(spark, "out")
    stream = lambda: news.unseen_urls(news.file_stream(spark, str(tmp_path / "in"), 1))
    assert {r["url"] for r in news.run_to(stream(), out, check).collect()} == {"u1", "v0", "v1"}
    spark.createDataFrame([("u1",), ("v9",)], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r["url"] for r in news.run_to(stream(), out, check).collect()) == ["u1", "v0", "v1", "v9"]  # resumed


def test_topics(spark):
    t = spark.createDataFrame([(0, 0.9, "a", "x y"), (0, 0.8, "b", "z"), (0, 0.8, "c", "q")], "topic int, prob double, id string, title string")
    got = topics.packed_titles(t, 3).first()
    assert got["text"] == "Title: x y\nTitle: z" and got["n_titles"] == 2  # may exceed by one
    rng = random.Random(2)
    v = [(i, [rng.gauss(5 * (i % 3), 0.1) for _ in range(20)]) for i in range(60)]
    got = topics.cluster(spark.createDataFrame(v, "id long, v array<double>"), "id", "v", k=3, components=4).collect()
    assert len(got) == 60 and all(0 <= r["topic_prob"] <= 1 for r in got)


def _core():
    import importlib

    import __spark_entry__ as entry

    return {n: f for m in entry._MODULES for n, f in importlib.import_module(m).QUERIES.items()}


@pytest.mark.parametrize("name", sorted(_core()))
def test_every_core_query_runs(spark, name):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    df = _core()[name](spark, folder)
    rows = df.collect()
    assert df.columns and all(len(r) == len(df.columns) for r in rows)
