"""English analysis: words, stop words and stems (Porter's published algorithm), term by term and once per distinct term."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English function words.
STOP = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing "
    "down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not "
    "now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with would you your".split()
)


def _forms(stem: str) -> str:
    """The stem as consonants (c) and vowels (v)."""
    out = []
    for i, c in enumerate(stem):
        out.append("v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _forms(stem)))


def _short(stem: str) -> bool:
    return _forms(stem).endswith("cvc") and stem[-1] not in "wxy"


_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and "v" in _forms(w[: -len(s)]):
                w, again = w[: -len(s)], True
                break
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _forms(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _forms(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        s = _longest(w, rules)
        if s and _measure(w[: -len(s)]):
            w = w[: -len(s)] + rules[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def words(text: Column) -> Column:
    """Distinct lower-case words of letters without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0)), lambda w: ~w.isin(*STOP)))


def stems_of(terms: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms (term): a language's vocabulary, however long its texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"term": b["term"], "stem": [stem(t) for t in b["term"]]})

    return terms.select("term").distinct().mapInPandas(run, "term string, stem string")


def relevance(df: DataFrame, id: str, asked: str, given: str, least: float) -> DataFrame:
    """(id, similarity) of rows whose two texts share at least this part of their stems; both texts without any give none."""
    rows = df.select(F.col(id).alias(id), words(F.col(asked)).alias("a"), words(F.col(given)).alias("b"))
    sides = F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("w")), F.struct(F.lit(2).alias("side"), F.col("b").alias("w"))))
    each = rows.select(id, sides).select(id, "side", F.explode("w").alias("term"))
    held = each.join(stems_of(each), "term").groupBy(id, "stem").agg(F.bit_or("side").alias("sides"))
    n = held.groupBy(id).agg((F.count_if(F.col("sides") == 3) / F.count("*")).alias("similarity"))
    return n.where(F.col("similarity") >= least).select(id, F.round("similarity", 6).alias("similarity"))
