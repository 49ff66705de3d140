"""Pluggable language models with deterministic offline defaults, and what works on their output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import strip
from newsloom.session import checkpointed

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SPAN = re.compile(r"\b[A-Z][\w’'&-]+(?: [A-Z][\w’'&-]+)+|\b[A-Z]{2,}\b")


def hashing_encoder(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            out[i, h % size] += 1 if h >> 63 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def capitalised_spans(text: str) -> list[str]:
    """Entities by default: runs of capitalised words and acronyms, in order, once each."""
    return list(dict.fromkeys(_SPAN.findall(text or "")))


def leading_sentences(text: str, n: int = 2) -> str:
    """Generation by default: the first sentences."""
    return " ".join(_SENTENCE.split((text or "").strip())[:n])


def generated(df: DataFrame, text: str, out: str, generator: Callable[[str], str] = leading_sentences) -> DataFrame:
    """``df`` with ``out`` from a generator, in batches; where it fails the value is null and the row stays."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return generator(x)
            except Exception:
                return None

        return s.map(one)

    return df.withColumn(out, run(F.col(text)))


def pack_sentences(text: str, size: int = 512, overlap: int = 64) -> list[str]:
    """Chunks of whole sentences up to ``size`` words; each begins with the last sentences of the one before, up to
    ``overlap`` words. A longer sentence is a chunk by itself."""
    chunks: list[list[str]] = []
    now: list[str] = []
    n = 0
    for s in [x for x in _SENTENCE.split(text or "") if x.strip()]:
        k = len(s.split())
        if now and n + k > size:
            chunks.append(now)
            back: list[str] = []
            m = 0
            for p in reversed(now):
                w = len(p.split())
                if m + w > overlap or m + w + k > size:
                    break
                back.insert(0, p)
                m += w
            now, n = back, m
        now.append(s)
        n += k
    return [" ".join(c) for c in [*chunks, now] if c]


def chunked(df: DataFrame, id: str, text: str, size: int = 512, overlap: int = 64, entities: Callable[[str], list[str]] = capitalised_spans) -> DataFrame:
    """(id, chunk_no, chunk, entities): chunks and their entities, aligned by position."""

    @F.pandas_udf("array<struct<chunk:string,entities:array<string>>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"chunk": c, "entities": entities(c)} for c in pack_sentences(t, size, overlap)])

    return df.select(F.col(id).alias("id"), F.posexplode(run(F.col(text))).alias("chunk_no", "x")).select("id", "chunk_no", "x.*")


def rewrite_references(tokens: list[str], tags: list[str], spaces: list[str], clusters: list[list[list[int]]], first_mention: bool = False) -> str:
    """Text in which every mention of a cluster is its head.

    The head is the first span with a noun (or, if asked, the first mention); clusters without one stay. Spans that
    contain another span of any cluster stay, unless the head is the first mention. A possessive mention gets a possessive head.
    """
    out = [t + s for t, s in zip(tokens, spaces)]
    spans = [tuple(m) for c in clusters for m in c]
    for c in clusters:
        noun = [m for m in c if any(tags[i] in ("NOUN", "PROPN", "NN", "NNS", "NNP", "NNPS") for i in range(m[0], m[1] + 1))]
        head = c[0] if first_mention and c else noun[0] if noun else None
        if head is None:
            continue
        text = "".join(t + s for t, s in zip(tokens[head[0] : head[1] + 1], spaces[head[0] : head[1] + 1])).rstrip()
        for a, b in c:
            holds = not first_mention and any((a, b) != (x, y) and a <= x and y <= b for x, y in spans)
            if [a, b] == list(head) or holds:
                continue
            out[a] = text + ("'s" if tags[b] in ("PRP$", "POS") else "") + spaces[b]
            for i in range(a + 1, b + 1):
                out[i] = ""
    return "".join(out)


def topic_edges(probabilities: list[list[float]], threshold: float = 0.4, similar: list[float] | None = None, share: float = 0.5) -> list[tuple[set[int], float]]:
    """Hyper-edges over sentences: members have the topic with this probability, the weight is its mean probability,
    blended with the members' mean similarity to a query where there is one."""
    p = np.asarray(probabilities, float)
    out = []
    for t in range(p.shape[1] if p.size else 0):
        members = set(np.flatnonzero(p[:, t] >= threshold).tolist())
        if members:
            w = float(p[:, t].mean())
            out.append((members, w if similar is None else share * w + (1 - share) * float(np.mean([similar[i] for i in members]))))
    return out


def cover(lengths: list[int], edges: list[tuple[set[int], float]], budget: int) -> list[int]:
    """Sentences chosen greedily by edge weight per length within a budget, in text order; what a chosen sentence
    covers is taken off the others, every time."""
    weight = {i: sum(w for e, w in edges if i in e) / n if n else 0.0 for i, n in enumerate(lengths)}
    left, chosen, total = list(range(len(lengths))), [], 0
    while left:
        best = max(left, key=lambda i: (weight[i], -i))
        left.remove(best)
        if lengths[best] + total < budget:
            chosen.append(best)
            total += lengths[best]
            for s in left:
                if lengths[s]:
                    weight[s] -= sum(w for e, w in edges if best in e and s in e) / lengths[s]
    return sorted(chosen)


def extractive_summary(df: DataFrame, id: str, text: str, budget: int = 60, topics: int = 4) -> DataFrame:
    """(id, summary): sentences that cover a document's topics, by hashed word vectors cut into ``topics`` parts."""

    def one(t: str) -> str:
        s = [x for x in _SENTENCE.split(t or "") if x.strip()]
        if not s:
            return ""
        v = np.abs(np.asarray(hashing_encoder(s))).reshape(len(s), topics, -1).sum(2)
        p = v / np.maximum(v.sum(1, keepdims=True), 1e-12)
        keep = cover([len(x.split()) for x in s], topic_edges(p.tolist(), 1.2 / topics), budget)
        return " ".join(s[i] for i in keep)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return df.select(F.col(id).alias("id"), run(F.col(text)).alias("summary"))


def first_of_both(rows: DataFrame, by: list[str], order: str, a: str, b: str) -> DataFrame:
    """Rows that, taken in order within their group, have both a value of ``a`` and one of ``b`` that no row kept before has.

    A row that comes first with both is kept; one that shares a value with a kept row before it goes; so each round
    decides every row that has no open row with one of its values before it. ``order`` must tell rows apart.
    """
    state = rows.withColumn("__kept", F.lit(None).cast("boolean"))
    kept, open_ = F.col("__kept") == True, F.col("__kept").isNull()  # noqa: E712
    while True:
        for i, c in enumerate((a, b)):
            w = Window.partitionBy(*by, c)
            state = state.withColumn(f"__k{i}", F.min(F.when(kept, F.col(order))).over(w)).withColumn(f"__o{i}", F.min(F.when(open_, F.col(order))).over(w))
        before = lambda x: F.coalesce(F.col(x) < F.col(order), F.lit(False))
        goes, waits = before("__k0") | before("__k1"), before("__o0") | before("__o1")
        now = F.when(~open_, F.col("__kept")).when(goes, F.lit(False)).when(~waits, F.lit(True))
        state = checkpointed(state.withColumn("__kept", now).drop("__k0", "__k1", "__o0", "__o1"))
        if state.where(open_).isEmpty():
            return state.where(kept).drop("__kept")


def corpus_texts(df: DataFrame, id: str, text: str, least: int) -> DataFrame:
    """(id, text) of a retrieval corpus: ids as numbers, texts stripped, shorter ones left out."""
    rows = df.select(F.col(id).cast("long").alias("id"), strip(F.col(text)).alias("text"))
    return rows.where(F.length("text") >= least)
