"""Mentions rewritten as what they mention: a pluggable finder of clusters, with a rule for pronouns as its default."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from newsloom.operators.language_tools import rewrite_references

Found = tuple[list[str], list[str], list[str], list[list[list[int]]]]

_TOKEN = re.compile(r"(\w+(?:['’&-]\w+)*|[^\w\s])(\s*)")
_PRONOUNS = {"it": "PRP", "he": "PRP", "she": "PRP", "they": "PRP", "its": "PRP$", "his": "PRP$", "her": "PRP$", "their": "PRP$"}
_END = re.compile(r"[.!?]")
_BREAK = "\n\n"
BEFORE = 5


def pronoun_clusters(text: str) -> Found:
    """(tokens, tags, white space after each, clusters): every pronoun with the last name of two words or more before it."""
    tokens, spaces = map(list, zip(*_TOKEN.findall(text))) if _TOKEN.search(text) else ([], [])
    tags, clusters, by_head, at = [], [], {}, None
    start = 0
    for i, t in enumerate(tokens):
        low = t.lower()
        name = t[0].isupper() and low not in _PRONOUNS
        tags.append(_PRONOUNS.get(low) or ("PROPN" if name else "PUNCT" if _END.match(t) else "X"))
        if name and i and tags[i - 1] == "PROPN":
            if i - start:
                at = (start, i)
        elif name:
            start = i
        if low in _PRONOUNS and at is not None:
            if at not in by_head:
                by_head[at] = [list(at)]
                clusters.append(by_head[at])
            by_head[at].append([i, i])
    return tokens, tags, spaces, clusters


def rewritten(text: str, finder: Callable[[str], Found] = pronoun_clusters, first_mention: bool = False) -> str:
    return rewrite_references(*finder(text), first_mention=first_mention)


def rewritten_by_window(text: str, finder: Callable[[str], Found] = pronoun_clusters, before: int = BEFORE) -> str:
    """Sentence by sentence, each seen with those before it as they have become."""
    said = [s for s in re.split(r"(?<=[.!?])\s+|\n\s*\n", text) if s.strip()]
    for i, s in enumerate(said):
        if not i:
            said[i] = rewritten(s, finder).strip()
            continue
        context = " ".join(" ".join(said[max(0, i - before) : i]).split())
        parts = rewritten(f"{context} {_BREAK} {s}", finder).split(_BREAK)
        if len(parts) != 2:
            raise ValueError("a sentence with an empty line")
        said[i] = parts[1].strip()
    return " ".join(said)


def resolved(df: DataFrame, id: str, text: str, resolve: Callable[[str], str] = rewritten) -> DataFrame:
    """(id, coref) of every text that can be rewritten; null and blank texts and failures are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b[id], b[text]):
                try:
                    got = resolve(t.strip()) if t and t.strip() else None
                except Exception:
                    got = None
                if got:
                    ids.append(i)
                    out.append(got)
            if ids:
                yield pd.DataFrame({"id": ids, "coref": out})

    return df.select(id, text).mapInPandas(run, f"id {df.schema[id].dataType.simpleString()}, coref string")
