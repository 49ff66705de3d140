import itertools
import random
import time
import re

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import language, mixing, packing, qa_defects, splitting

GPT2 = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def split_kind(text, limit):
    lines = text.split("\n")
    if all(len(x.split()) <= limit for x in lines):
        return "line"
    sentences = [s for x in lines for s in re.split(r"(?<=[.!?\"'”’»“›])\s+", x)]
    return "sentence" if all(len(s.split()) <= limit for s in sentences) else "none"


def test_splitting(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "one", "\n\n  " + "a b. " * 30, "x" * 5000, " ".join("word" for _ in range(100))]
    for _ in range(60):
        n = rng.randrange(1, 120)
        texts.append("".join(rng.choice(("w", "word", "end.", "said”", "q?", "ü")) + rng.choice((" ", " ", " ", "\n", " ", "  \n\n")) for _ in range(n)))
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id int, body string, n_words int")
    got = splitting.split_text(df, "body", limit=20, overlap=4).withColumn("boundary", splitting.boundary(F.col("pieces"))).collect()
    assert len(got) == len(texts)
    for r in got:
        t, pieces = texts[r["id"]], r["pieces"]
        if t is None:
            assert pieces is None
            continue
        assert r["n_words"] == len(t.split())
        whole = ""
        for k, p in enumerate(pieces):
            assert len(p["text"].split()) == p["n_words"] <= 20 and p["n_overlap"] <= 4 and p["piece_no"] == k
            lead = re.match(r"(?:\S+\s*){%d}" % p["n_overlap"], p["text"]) if p["n_overlap"] else None
            whole += p["text"][lead.end() :] if lead else p["text"]
        assert whole == t
        if r["n_words"] > 20:
            assert r["boundary"] == split_kind(t, 20), t
    assert splitting.pieces(df.limit(0), "body").count() == 0


def test_packing(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "it's  fine\n\n\tx 12½ ’—"] + ["the same text here"] * 300 + [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    texts.append("long " * 777)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    got = packing.pack(df, "doc_id", "text", capacity=64, open_containers=32).collect()
    size = {i: len(GPT2.findall(t or "")) for i, t in enumerate(texts)}
    held, parts = {}, {}
    for r in got:
        held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
        parts.setdefault(r["id"], []).append((r["part"], r["start"], r["tokens"]))
    assert max(held.values()) <= 64
    assert {i: sum(n for _, _, n in p) for i, p in parts.items()} == {i: n for i, n in size.items() if n}
    assert all(len(p) == 1 or size[i] > 64 for i, p in parts.items())
    assert sum(size.values()) / 64 / len(held) > 0.9
    long = texts[-1]
    cuts = spark.createDataFrame([(s, n) for _, s, n in sorted(parts[len(texts) - 1])], "s int, n int")
    assert "".join(r[0] for r in cuts.orderBy("s").select(packing.part_text(F.lit(long), F.col("s"), F.col("n"))).collect()) == long
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_hilbert_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_key(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    order = points[np.argsort(keys)]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x", "y", "xy"]), st.integers(1, 30)), max_size=8), st.integers(1, 3))
def test_flow_is_greatest_and_within_bounds(parts, repeats):
    supply, capacity = {}, {}
    for p, sources, n in parts:
        supply[p] = supply.get(p, 0) + n
        for s in sources:
            capacity[p, s] = capacity.get((p, s), 0) + n * repeats
    quota = {"x": 40, "y": 25}
    flow = mixing.min_cost_flow(supply, capacity, quota)
    for s in quota:
        assert sum(f for (p, q), f in flow.items() if q == s) == min(quota[s], sum(c for (p, q), c in capacity.items() if q == s))
    assert all(0 < f <= capacity[k] for k, f in flow.items())


def test_flow_avoids_repetition():
    flow = mixing.min_cost_flow({"both": 10, "only": 10}, {("both", "x"): 30, ("only", "x"): 30, ("both", "y"): 30}, {"x": 10, "y": 10})
    assert flow == {("only", "x"): 10, ("both", "y"): 10}


def test_mixing(spark):
    rows = [(i, "word " * (5 + i % 7), "a", 0) for i in range(200)] + [(1000 + i, "word " * 6, "b", 0) for i in range(10)] + [(2000, "z", "other", 0), (2001, None, "a", 0), (2002, "", "b", 0), (2003, "x", None, 0)]
    rows += [(3000 + i, "shared text of both " * 3, s, 0) for i, s in enumerate("ab" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 2), ("none", 0.0, 1), ("gone", 0.2, 3)], "source string, target_share double, max_repeats int")
    picked, report = mixing.mix(df, targets)
    r = {x["source"]: x for x in report.collect()}
    assert not r["gone"]["reachable"] and r["none"]["reachable"] and r["b"]["reachable"]
    assert abs(r["b"]["used_tokens"] - r["b"]["target_tokens"]) <= 20 and r["b"]["most_uses"] <= 2
    uses = picked.collect()
    assert len({x["id"] for x in uses}) == len(uses) and {x["id"] for x in uses}.isdisjoint({2000, 2001, 2002, 2003})
    again = {x["id"]: x["uses"] for x in mixing.mix(df.repartition(3), targets)[0].collect()}
    assert again == {x["id"]: x["uses"] for x in uses}
    picked, report = mixing.mix(df.limit(0), targets)
    assert picked.count() == 0 and report.count() == 4
    many = spark.createDataFrame([(f"s{i}", 0.01, 1) for i in range(70)] + [("a", 0.3, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, many)[1].count() == 71


def test_flow():
    # Two sources share a pattern; each has one of its own that is too small. The shared one is repeated only where it must be.
    flow = mixing.min_cost_flow({"a": 10, "b": 10, "ab": 20}, {("a", "a"): 20, ("b", "b"): 10, ("ab", "a"): 40, ("ab", "b"): 20}, {"a": 25, "b": 15})
    into = lambda q: sum(f for (_, s), f in flow.items() if s == q)
    assert into("a") == 25 and into("b") == 15 and sum(f for (p, _), f in flow.items() if p == "ab") == 20
    # A quota that cannot be filled is filled as far as it goes, rerouting what others can have elsewhere.
    flow = mixing.min_cost_flow({"x": 10, "y": 5}, {("x", "p"): 10, ("y", "p"): 5, ("x", "q"): 10}, {"p": 5, "q": 20})
    assert sum(f for (_, s), f in flow.items() if s == "q") == 10 and sum(f for (_, s), f in flow.items() if s == "p") == 5
    start = time.time()
    assert mixing.min_cost_flow({"one": 1}, {("one", "s"): 10**9}, {"s": 200_000}) == {("one", "s"): 200_000} and time.time() - start < 1
    assert mixing.segments(3, 40) == [3, 3, 6, 12, 16]


def test_splitting_by_characters_and_long_white_space(spark):
    texts = [" " * 60_000 + "word " * 30, "x" * 5000 + " and " + "y" * 700, "short", None, " ".join("abcdefghij" for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for r in splitting.split_text(df, "body", limit=20, overlap=0, characters=1000).collect():
        if texts[r["id"]] is not None:
            assert "".join(p["text"] for p in r["pieces"]) == texts[r["id"]] and all(len(p["text"]) <= 1000 for p in r["pieces"])
    got = {r["id"]: r["pieces"] for r in splitting.split_text(df, "body", limit=20, overlap=4).collect()}
    assert len(got[1]) == 1 and sum(len(p["text"]) for p in got[0]) >= len(texts[0])
    kinds = {r["id"]: {p["cut"] for p in r["pieces"]} for r in splitting.split_text(df.where("id = 1"), "body", limit=20, characters=1000).collect()}
    assert "character" in kinds[1]


EN = "The board of the company said that it will not raise the dividend before the end of the year."
DE = "Der Vorstand des Unternehmens will die Dividende nach eigenen Angaben nicht vor dem Jahresende erhöhen."
FR = "Le conseil de la société ne veut pas augmenter le dividende avant la fin de cette année, selon ses dirigeants."


@pytest.fixture(scope="module")
def profiles(spark):
    return language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))


def test_languages(spark, profiles):
    texts = [EN, f"{DE}\n\n{FR}", f"{EN} {EN} “{FR}” {EN}", DE.upper(), "### 12.5 | 3\nhttps://www.x.example/le/la\nAB3 4.5", "", None, EN]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    parts = language.judged(df, profiles)
    lines = {(r["id"], r["line_no"]): r["lang"] for r in language.line_languages(parts).collect()}
    assert lines == {(0, 0): "en", (1, 0): "de", (1, 2): "fr", (2, 0): "en", (3, 0): "de", (7, 0): "en"}
    docs = {r["id"]: r for r in language.document_languages(parts).collect()}
    assert set(docs) == {0, 1, 2, 3, 7} and all(0.5 <= r["confidence"] <= 1 for r in docs.values())
    seg = language.segments(parts).where("id = 1").orderBy("segment").collect()
    assert [(r["lang"], r["first_line"], r["last_line"]) for r in seg] == [("de", 0, 0), ("fr", 2, 2)]


def test_labels(spark):
    labels = [("en", "en"), (" English ", "en"), ("fr_CA", "fr"), ("en-US", "en"), ("GER", "de"), ("deu", "de"), ("und", None), ("--", None), (None, None), ("", None), ("pt-BR", "pt"), ("unknown", None), ("englisch-x", None)]
    df = spark.createDataFrame([(a, b) for a, b in labels], "a string, b string")
    assert all(r[0] == r[1] for r in df.select("b", language.label_language(F.col("a"))).collect())


def test_held_out_accuracy(spark):
    import os

    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(folder).select("doc_id", "text", "lang").cache()
    fitted = language.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 and length(text) > 100").withColumn("label", language.label_language(F.col("lang"))).where("label is not null")
    got = language.document_languages(language.judged(rest, fitted)).withColumnRenamed("id", "doc_id").withColumnRenamed("lang", "found").join(rest, "doc_id")
    share = got.agg(F.avg((F.col("found") == F.col("label")).cast("double"))).first()[0]
    assert share > 0.9  # some labels are wrong


def test_other_scripts_are_of_no_known_language(spark, profiles):
    texts = ["Совет директоров не будет повышать дивиденды.", "董事会今年不会提高股息。", f"{EN}\nСовет не будет повышать дивиденды."]
    parts = language.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profiles)
    assert {(r["id"], r["line_no"]): r["lang"] for r in language.line_languages(parts).collect()} == {(0, 0): "und", (1, 0): "und", (2, 0): "en", (2, 1): "und"}


def test_qa_defects(spark):
    import os

    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    profiles = language.fit(spark.read.parquet(folder))
    ask = ["Why did Norvane Energy delay its plan in Calder Bay?", "Who advised Norvane Energy on the stake purchase?", "How many people work at the site of Norvane Energy?", "When will Norvane Energy close the merger?"]
    other = "What will Norvane Energy earn from its cloud unit in 2015?"
    rows = [
        (1, ask[0], other, "Because its costs rose by 3 percent and the bank asked for more security.", None), (2, ask[1], other, "Tovane Bank", None),
        (3, ask[2], other, "302", None), (4, ask[3], other, "In May 2022.", None), (5, ask[0], other, None, "empty"), (6, ask[0], other, " N/A ", "empty"),
        (7, None, other, "It will.", "empty"), (8, ask[0], "--", "It will.", "empty"), (9, ask[0], other, "You asked: " + ask[0], "copied"),
        (10, ask[0], other, other.lower(), "copied"), (11, ask[0], other, "The company cited weaker demand in the region and cannot fini", "truncated"),
        (12, ask[2], other, "302. Traders in Calder Bay piled in as headcount, although ...", "truncated"), (13, ask[0], other, DE, "language"),
        (14, ask[0], other, "The statement, headed “Der Gewinn fiel um 3 Prozent”, says the plan needs more money than expected.", None),
        (15, ask[1], other, "Shares of both companies slid after Ann Ulven refused to answer questions.", None),
        (16, ask[1], other, f"Asked “{ask[1]}”, Ann Ulven said: I cannot answer this question based on the text.", None),
        (17, ask[0], other, "Mainly currency swings, which it does not know how to hedge yet.", None), (18, ask[0], other, "I'm sorry, but I can't help with that.", "refusal"), (19, ask[1], other, "I'm sorry, but I can't help with that.", "refusal"),
    ]
    rows += [(100 + i, ask[i % 4], other, f"We are not able to discuss {'the plans of ' * (i % 2)}Norvane Energy at this point.", "refusal") for i in range(12)]
    rows += [(200 + i, ask[2], other, f"The text does not say more than that {i} people work there.", None) for i in range(12)]  # one kind of question only
    rows += rows[:1]
    df = spark.createDataFrame([(*r[:4], r[0]) for r in rows], "qa_id long, answerable string, unanswerable string, answer string, opening long").withColumn("context", F.lit(None).cast("string"))
    got = {r["id"]: r["defect"] for r in qa_defects.defects(df, profiles).collect()}
    assert {r[0]: (r[4], got[r[0]]) for r in rows if got[r[0]] != r[4]} == {}
    assert qa_defects.defects(df.limit(0), profiles).count() == 0
