"""Sources mixed to target shares of the tokens, with capped repetition.

Documents of the listed sources are aggregated by membership pattern: the set of listed sources in which
a document's text occurs. Tokens then flow from patterns to source quotas at least cost. A pattern's first
use of its distinct texts is free, the second costs one, the next two two, the next four three, and so on (convex
repetition costs, in as many segments as the logarithm of the repetitions), and a
source draws from a pattern at most ``max_repeats`` times the tokens of its own documents there; so every
share that can be reached is reached, with repetition kept even. A source whose quota the flow does not fill cannot
reach its share. The flow runs on the driver over the patterns that occur, not over documents.
Last, documents are selected in the order of a seeded hash until each flow is met, found by cumulating over
hash buckets first, so that only the documents of the bucket in which a flow ends are ordered.

Cases: documents without source, without text, or of unlisted sources are left out; empty texts have
no tokens and are never used; a listed source without documents cannot reach a positive share; ties of the
hash are broken by the id; sources listed twice count by their first row; there may be any number of sources; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.stage import staged
from newsloom.llm.packing import n_tokens
from newsloom.session import checkpointed

#: Hash buckets per pattern and source in which documents are counted before they are ordered.
BUCKETS = 4096


def segments(supply: int, room: int) -> list[int]:
    """Capacity of each cost level of a pattern: one round, one more, then twice as many as before, up to ``room``."""
    out, width = [], supply
    while room > 0:
        out.append(min(width, room))
        room -= out[-1]
        width = supply if len(out) == 1 else 2 * width
    return out


def min_cost_flow(supply: dict, capacity: dict, quota: dict) -> dict:
    """Flow (pattern, source) -> tokens: as much of the quotas as can be met, at least repetition cost.

    ``supply``: distinct tokens of each pattern. ``capacity``: most tokens per (pattern, source). ``quota``: tokens per
    source. Only drawing from a pattern costs, so a cheapest augmenting path is one from the cheapest open segment of
    any pattern: levels of cost are opened in turn, and within one the flow is augmented along shortest paths until
    none is left.
    """
    arcs: dict = defaultdict(dict)
    for (p, q), c in sorted(capacity.items()):
        if c > 0 and q in quota and supply.get(p, 0) > 0:
            arcs[p][q] = c
    flow = {(p, q): 0 for p in arcs for q in arcs[p]}
    drawn_from = defaultdict(set)  # patterns from which a source draws
    left = dict(quota)
    steps = {p: segments(supply[p], sum(arcs[p].values())) for p in arcs}
    for level in range(max(map(len, steps.values()), default=0)):
        room = {p: s[level] for p, s in steps.items() if level < len(s)}
        while room:
            # Breadth first from every pattern with room, over arcs with capacity left and back over flows, to an open quota.
            via: dict = {("p", p): None for p in room}
            queue = deque(via)
            end = None
            while queue and end is None:
                kind, n = node = queue.popleft()
                if kind == "p":
                    for q, c in arcs[n].items():
                        if flow[n, q] < c and ("q", q) not in via:
                            via["q", q] = node
                            if left[q] > 0:
                                end = ("q", q)
                                break
                            queue.append(("q", q))
                else:
                    for p in drawn_from[n]:
                        if ("p", p) not in via:
                            via["p", p] = node
                            queue.append(("p", p))
            if end is None:
                break
            path = [end]
            while via[path[-1]] is not None:
                path.append(via[path[-1]])
            path.reverse()
            push = min(left[end[1]], room[path[0][1]])
            for (k, x), (_, y) in zip(path, path[1:]):
                push = min(push, arcs[x][y] - flow[x, y] if k == "p" else flow[y, x])
            for (k, x), (_, y) in zip(path, path[1:]):
                if k == "p":
                    flow[x, y] += push
                    drawn_from[y].add(x)
                else:
                    flow[y, x] -= push
                    if not flow[y, x]:
                        drawn_from[x].discard(y)
            left[end[1]] -= push
            first = path[0][1]
            room[first] -= push
            if not room[first]:
                del room[first]
    return {k: f for k, f in flow.items() if f}


def mix(df: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    Selection: (id, source, tokens, uses) of the documents used. Report, per listed source: target_share,
    max_repeats, docs, tokens, target_tokens, capacity, flow_tokens, reachable (whether the flow fills its quota), used_docs,
    used_tokens, most_uses, actual_share. The total that is aimed at is the tokens of all documents of all listed sources.
    """
    spark = df.sparkSession
    listed = targets.where("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
    wanted = {r["source"]: (float(r["t"][0] or 0), int(r["t"][1] or 0)) for r in listed.collect()}  # the list of targets
    names = sorted(wanted)
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("source")).cast("int") - 1 if names else F.lit(-1)
    rows = df.select(df[id].alias("id"), df[source].cast("string").alias("source"), df[text].alias("text")).where(
        F.col("source").isin(names) & F.col("text").isNotNull()
    )
    sized = staged(rows, ["id", "source"], {"tokens": n_tokens(F.col("text")).cast("long"), "h1": F.xxhash64("text"), "h2": F.md5("text"), "q": number})
    sized = checkpointed(sized)
    bits = sized.groupBy("h1", "h2").agg(F.array_join(F.array_sort(F.collect_set("q")), ",").alias("pattern"), F.max("tokens").alias("t"))
    docs = sized.join(bits.select("h1", "h2", "pattern"), ["h1", "h2"]).select("id", "source", "q", "pattern", "tokens")
    docs = checkpointed(docs.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(BUCKETS)).cast("int")))

    distinct = {r["pattern"]: int(r["t"]) for r in bits.groupBy("pattern").agg(F.sum("t").alias("t")).collect()}
    held = {(r["pattern"], r["source"]): int(r["t"]) for r in docs.groupBy("pattern", "source").agg(F.sum("tokens").alias("t")).collect()}
    by_source = {n: sum(t for (_, s), t in held.items() if s == n) for n in names}
    total = sum(by_source.values())
    quota = {n: math.ceil(wanted[n][0] * total) for n in names}
    flow = min_cost_flow(distinct, {k: wanted[k[1]][1] * t for k, t in held.items()}, quota)

    plan = [(p, s, f // held[p, s], f % held[p, s]) for (p, s), f in flow.items()]
    plan = spark.createDataFrame(plan, "pattern string, source string, base long, rest long")
    binned = docs.groupBy("pattern", "source", "bucket").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("pattern", "source").orderBy("bucket")  # at most BUCKETS rows
    binned = binned.withColumn("before", F.sum("t").over(w) - F.col("t")).join(plan, ["pattern", "source"])
    marked = docs.join(binned, ["pattern", "source", "bucket"])
    inside = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))  # one bucket of each flow
    last = marked.where(inside)
    w = Window.partitionBy("pattern", "source", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
    running = F.col("before") + F.sum("tokens").over(w) - F.col("tokens") / 2
    chosen = last.withColumn("uses", F.col("base") + (running < F.col("rest")).cast("long"))
    rest = marked.where(~inside).withColumn("uses", F.col("base") + (F.col("before") < F.col("rest")).cast("long"))
    picked = chosen.unionByName(rest).where("uses > 0 and tokens > 0").select("id", "source", "tokens", "uses")

    used = picked.groupBy("source").agg(
        F.count("*").alias("used_docs"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses")
    )
    have = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    into = {n: sum(f for (_, q), f in flow.items() if q == n) for n in names}
    frame = spark.createDataFrame([(n, *wanted[n], into[n], into[n] >= quota[n]) for n in names], "source string, target_share double, max_repeats int, flow_tokens long, reachable boolean")
    report = frame.join(have, "source", "left").join(used, "source", "left").na.fill(0)
    everything = report.agg(F.sum("used_tokens").alias("all"))
    report = report.crossJoin(F.broadcast(everything))  # one row
    report = report.select(
        "source", "target_share", "max_repeats", "docs", "tokens", F.round(F.col("target_share") * total).cast("long").alias("target_tokens"),
        (F.col("max_repeats") * F.col("tokens")).alias("capacity"), "flow_tokens", "reachable",
        "used_docs", "used_tokens", "most_uses", F.round(F.try_divide("used_tokens", "all"), 6).alias("actual_share"),
    )
    return picked, report
