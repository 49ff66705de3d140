import random
import re

from pyspark.sql import functions as F

from newsloom.llm.incremental import IncrementalIndex
from newsloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(4000)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(t, share):
    w = t.split()
    return " ".join(RNG.choice(VOCABULARY) if RNG.random() < share else x for x in w)


def grams(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similar(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def corpus():
    rows = [text(RNG.choice((6, 40, 120))) for _ in range(60)]
    rows += [edited(t, s) for t in rows[:40] for s in (0.01, 0.03, 0.08, 0.15)]
    rows += [rows[0]] * 30 + ["", None, "four words are here", "four words are here", " "]  # a hot group of copies
    return rows


def test_pairs_against_brute_force(spark):
    texts = corpus()
    rows = [(str(i), t, "x") for i, t in enumerate(texts)] + [("5", texts[5], "x")]
    df = spark.createDataFrame(rows, "id string, body string, key string")
    for threshold in (0.5, 0.8):
        want = {(a, b) if a < b else (b, a) for i, s in enumerate(texts) for j, t in enumerate(texts[:i]) if similar(s, t) >= threshold for a, b in [(str(i), str(j))]}
        got = {(r["id_a"], r["id_b"]) for r in near_duplicate_pairs(df, "id", F.col("body"), threshold).collect()}
        assert got == want
    assert near_duplicate_pairs(df.limit(0), "id", F.col("body")).count() == 0


def test_groups(spark):
    t = text(100)
    rows = [("a", t), ("b", t), ("c", t + " and more"), ("d", text(100)), ("e", None)]
    got = {r["id"]: r for r in near_duplicate_groups(spark.createDataFrame(rows, "id string, body string"), "id", F.col("body")).collect()}
    assert set(got) == set("abcd")
    assert got["a"]["group_id"] == got["b"]["group_id"] == got["c"]["group_id"] != got["d"]["group_id"]
    assert got["a"]["n_links"] == 1 and got["d"]["n_links"] == 0


def sequential(history, batches):
    seen = [(u, b) for _, u, b in history]
    out = set()
    for batch, n, i, u, b in sorted(batches, key=lambda r: (r[0], r[1])):
        if any((u and u == v) or similar(b, c) >= 0.5 for v, c in seen):
            out.add((batch, n, i))
        else:
            seen.append((u, b))
    return out


def test_incremental_against_sequential(spark):
    base = [text(60) for _ in range(30)]
    history = [(f"h{i}", f"https://a.example/{i}", t) for i, t in enumerate(base)] + [("h0", "https://a.example/0", base[0]), ("hn", None, None)]
    chain = [text(80)]
    for _ in range(6):
        chain.append(edited(chain[-1], 0.04))  # each like the one before, not all like the first
    rows = []
    for n in range(120):
        kind = n % 8
        body = {0: text(50), 1: edited(RNG.choice(base), 0.03), 2: chain[n // 8 % 7], 3: None, 4: "", 5: text(4), 6: RNG.choice(base), 7: edited(chain[n % 7], 0.02)}[kind]
        url = None if n % 11 == 0 else f"https://b.example/{n if n % 5 else n // 10}"
        rows.append((n // 40 + 1, n, f"i{n % 100}", url, body))
    want = sequential(history, rows)
    h = spark.createDataFrame(history, "id string, url string, body string")
    r = spark.createDataFrame(rows, "batch_no int, arrival_no long, id string, url string, body string")
    whole = IncrementalIndex.build(h).ingest(r, ["batch_no", "arrival_no"])
    assert {(x["batch_no"], x["arrival_no"], x["id"]) for x in whole.where("repeats").collect()} == want
    # batch by batch, each against the index that the one before left, which needs no text of the history
    index, got = IncrementalIndex.build(h), set()
    for b in (1, 2, 3):
        batch = r.where(F.col("batch_no") == b)
        got |= {(x["batch_no"], x["arrival_no"], x["id"]) for x in index.ingest(batch, ["batch_no", "arrival_no"]).where("repeats").collect()}
    assert got == want
    assert IncrementalIndex.build(h.limit(0)).ingest(r.limit(0), ["batch_no", "arrival_no"]).count() == 0


def test_chains_of_edits_are_decided_in_order(spark):
    """Each text resembles the one before only: every second is new, however long the chain."""
    words = text(80 + 20 * 30).split()
    rows = [(1, n, f"c{n}", None, " ".join(words[n * 20 : n * 20 + 80])) for n in range(30)]
    r = spark.createDataFrame(rows, "batch_no int, arrival_no long, id string, url string, body string")
    empty = spark.createDataFrame([], "id string, url string, body string")
    got = {x["id"] for x in IncrementalIndex.build(empty).ingest(r, ["batch_no", "arrival_no"]).where("repeats").collect()}
    assert got == {i for _, _, i in sequential([], rows)} and len(got) >= 15


def test_a_batch_reads_what_it_needs(spark):
    """The partitions read for one document do not grow with the history."""
    read = []
    for n in (2_500 * 8, 2_500 * 32):
        history = spark.range(n).select(
            F.col("id").cast("string").alias("id"), F.concat(F.lit("https://a.example/"), "id").alias("url"),
            F.concat_ws(" ", *[F.hash("id", F.lit(i)).cast("string") for i in range(12)]).alias("body"),
        )
        index = IncrementalIndex.build(history, docs_per_bucket=500)
        row = history.where("id = '77'").select(F.lit(1).alias("batch_no"), F.lit(1).cast("long").alias("arrival_no"), F.lit("x").alias("id"), F.lit("https://b.example").alias("url"), "body")
        seen = []
        hit = index.hit
        index.hit = lambda *a: seen.append(hit(*a)) or seen[-1]
        assert index.ingest(row, ["batch_no", "arrival_no"]).where("repeats").count() == 1
        read.append([x.count() for x in seen])
    assert all(b <= 2 * a for a, b in zip(*read)), read
    assert all(x < 2_500 * 2 for x in read[1][1:])  # parts and slices
