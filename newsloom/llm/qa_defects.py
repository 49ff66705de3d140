"""Defects of prompt and response pairs.

Refusals are found without any list of phrases. The first sentence of a response, with names and numbers masked, is its
template; templates are clustered by MinHash with verified similarity, and so are prompts, whole. A template whose cluster
recurs across unrelated prompts (prompts of several clusters, none with most of the rows) and whose rows say nothing
of their own is a refusal. A response says something of its own if its first sentence has a number or two names that its
questions and its context have not (one name, if it is in another language than its question), or three words in a row or most of its words from its questions; what recurs word for word over unrelated prompts does
not. The other defects need no corpus: an answer
or question that is missing or a stand-in is empty; an answer whose words are those of one of its
questions is copied; one in another language than its question (by hyperdimensional profiles) is of the wrong
language; one that does not end where a sentence ends, and is no terse answer, is truncated.

Each pair gets at most one defect, in the order empty, copied, refusal, language, truncated. An answer that
first cites ("Asked ..., someone said:") is judged by what follows, and is never a refusal: it reports one.

Cases: nulls in any column count as missing; a missing question of either kind makes the pair empty; numbers,
names and dates without a full stop are terse, not truncated; answers under four words are never refusals; very long
answers are read whole; repeated rows count once and
get the same defect each; openings that tie in spread are all refusals; an empty table gives no defects;
extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textvec as V
from newsloom.llm.language import LANGUAGES, Profiles, stretches, telling
from newsloom.llm.similarity import slices
from newsloom.session import checkpointed

# Stand-ins for nothing, in lower case; text without letters and digits is one as well.
STAND_INS = frozenset("n/a na n.a. none null nil nan tbd tba failed error unknown undefined empty missing keine aucune ninguno ninguna nichts".split())
# A refusal's cluster: least rows, most of them from one cluster of prompts, most that say something of their own, least words.
LEAST_ROWS, MOST_SHARE, MOST_OWN, LEAST_WORDS = 2, 0.8, 0.2, 4
#: Least similarity of templates, and of prompts, by their words.
ALIKE, ALIKE_PROMPTS = 0.6, 0.5
#: Lead in cosine that makes a language certain.
CLEAR = 0.06

_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_NUMBER = re.compile(r"\d[\d.,]*")
_CITES = re.compile(r"^(?:(?![.!?]\s)[^“\"«„])*[“\"«„][^”\"»]*[”\"»“],?\s+(?:(?:(?![.!?]\s)[^“\"«„:])*?\bsaid:|says\b)\s*")
_QUOTED = re.compile(r"[“\"«„‘][^”\"»“’]*[”\"»“’]")
_END = re.compile(r"[.!?][\"'”’»“)\]]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…|[–—-])\s*$")
_SENTENCE_END = re.compile(r"[.!?][\"'”’»“)\]]*\s+")
_SMALL = frozenset("and in by of on the to about million billion trillion percent per cent und im am et le en el de y a und dem".split())


def is_empty(text: str | None) -> bool:
    return text is None or not any(c.isalnum() for c in text) or text.strip().strip("\"'[](){}<>.").lower() in STAND_INS


def _first_words(text: str) -> list[str]:
    return _WORDS.findall(_SENTENCE_END.split(text.strip(), maxsplit=1)[0])


def _named(i: int, word: str) -> bool:
    return i > 0 and word[0].isupper() and word not in ("I", "I'm", "I’m", "AI")


def masked(words: list[str]) -> str:
    """Words in lower case; names but for the first word are n, numbers 9."""
    out: list[str] = []
    for i, w in enumerate(words):
        w = "9" if _NUMBER.match(w) else "n" if _named(i, w) else w.lower().replace("’", "'")
        if not (out and w in ("n", "9") and out[-1] == w):
            out.append(w)
    return " ".join(out)


def template(text: str) -> str:
    return masked(_first_words(text))


def _threes(words: list[str]) -> set[tuple[str, ...]]:
    """Three words in a row, none of them a name or number."""
    plain = [None if _NUMBER.match(w) or _named(i, w) else w.lower() for i, w in enumerate(words)]
    return {t for t in zip(plain, plain[1:], plain[2:]) if None not in t}


def says_something(answer: str, questions: tuple[str, ...], context: str | None = None, foreign: bool = False) -> bool:
    """Whether the first sentence has a number or two names that are in no question and not in the context (one name, if
    it is in another language than the question), or three words in a row or most of its words from a question."""
    words = _first_words(answer)
    if _threes(words) & {t for q in questions for t in _threes(_WORDS.findall(q))}:
        return True
    asked = {w.lower() for q in questions for w in _WORDS.findall(q)}
    plain = [w.lower() for i, w in enumerate(words) if not _NUMBER.match(w) and not _named(i, w)]
    if sum(w in asked for w in plain) > 0.6 * len(plain):
        return True
    known = None
    runs, numbers, last = 0, 0, -2
    for i, w in enumerate(words):
        number = _NUMBER.match(w) is not None
        if (number or _named(i, w)) and w.lower() not in asked:
            known = {x.lower() for x in _WORDS.findall(context or "")} if known is None else known
            if w.lower() not in known:
                numbers += number
                runs += not number and last != i - 1
                last = i
    return numbers > 0 or runs > (0 if foreign else 1)


def is_copy(answer: str, questions: tuple[str, ...]) -> bool:
    """Whether hardly a word of the answer is not of one of the questions, which it covers."""
    mine = _WORDS.findall(answer.lower())
    for q in questions:
        theirs = set(_WORDS.findall(q.lower()))
        if len(theirs) > 2 and sum(w not in theirs for w in mine) <= 2 and len(theirs & set(mine)) >= 0.8 * len(theirs):
            return True
    return False


def is_truncated(answer: str) -> bool:
    text = _CITES.sub("", answer.strip(), count=1).strip()
    broken = _ELLIPSIS.search(text)
    if not text or (broken and not any(c.isalnum() for c in text)):
        return True  # the citation's answer is missing
    if broken:
        return True
    if _END.search(text):
        return False
    parts = _SENTENCE_END.split(text)
    if len(parts) > 1:
        return True
    plain = [w for w in _WORDS.findall(text) if w[0].islower() and w not in _SMALL]
    return bool(plain) and len(_WORDS.findall(text)) > 2 or text[-1:] in ",;:"


def _unquoted(text: str) -> str:
    rest = _QUOTED.sub(" ", text)
    return rest if len(_WORDS.findall(rest)) >= 4 else text


def scored_languages(profiles: Profiles, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cosines with every language of each text, by its words, and how many words tell."""
    flat, owner, words = [], [], []
    for i, t in enumerate(texts):
        for _, s, n in stretches(t.replace("\n", " ")):
            flat.append(telling(s))
            owner.append(i)
            words.append(n)
    total, weight, tells = np.zeros((len(texts), len(LANGUAGES))), np.zeros(len(texts)), np.zeros(len(texts), int)
    for o, n, row, s in zip(owner, words, profiles.cosines(flat), flat):
        total[o] += n * row
        weight[o] += n
        tells[o] += len(_WORDS.findall(s))
    return total / np.maximum(weight, 1)[:, None], tells


def other_language(answer: np.ndarray, asked: np.ndarray, tells: np.ndarray) -> np.ndarray:
    """Whether answers are in another language than what was asked: each side's own language is ahead of the
    other's by CLEAR on both sides, and there are words enough to tell."""
    i = np.arange(len(answer))
    a, q = answer.argmax(1), asked.argmax(1)
    mine, theirs = answer[i, a] - answer[i, q], asked[i, q] - asked[i, a]
    return (a != q) & (np.minimum(mine, theirs) > CLEAR) & (tells >= 4)


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for b in slices(batches, 1000):
            q, u, a, c = (b.column(i).to_pylist() for i in (1, 2, 3, 4))
            kinds, templates, verbatim, prompts, own = [], [], [], [], []
            good = [not (is_empty(x) or is_empty(y) or is_empty(z)) for x, y, z in zip(q, u, a)]
            mine, tells = scored_languages(profiles, [_unquoted(z) if g else "" for z, g in zip(a, good)])
            theirs, _ = scored_languages(profiles, [f"{x} {y}" if g else "" for x, y, g in zip(q, u, good)])
            foreign = other_language(mine, theirs, tells)
            for x, y, z, about_text, g, f in zip(q, u, a, c, good, foreign):
                kind, about = None, None
                if not g:
                    kind = "empty"
                elif is_copy(z, (x, y)):
                    kind = "copied"
                else:
                    if f:
                        kind = "language"
                    elif is_truncated(z):
                        kind = "truncated"
                    if _CITES.match(z.strip()) is None:
                        about = template(z)
                kinds.append(kind)
                templates.append(about)
                verbatim.append(" ".join(_first_words(z)).lower() if about is not None else None)
                prompts.append(masked(_WORDS.findall(x)) if about is not None else None)
                own.append(says_something(z, (x, y), about_text, f) if about is not None else None)
            strings = [pa.array(v, pa.string()) for v in (kinds, templates, verbatim, prompts)]
            yield pa.RecordBatch.from_arrays([b.column(0), *strings, pa.array(own, pa.bool_())], names=["id", "kind", "template", "verbatim", "prompt", "own"])

    return run


BANDS, ROWS = 12, 2


def _real(text: str) -> list[str]:
    return sorted({w for w in text.split() if w not in ("n", "9")})


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash bands of the words of each masked text."""
    seeds = V.mix(np.arange(1, BANDS * ROWS + 1, dtype=V.U))
    for b in slices(batches, 2000):
        names, keys = [], []
        for i, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            real = _real(o)
            if not real:
                continue
            h = V.words([" ".join(w.replace("'", "") for w in real)])[0]
            least = V.mix(h[None] ^ seeds[:, None]).min(1).reshape(BANDS, ROWS)
            key = V.mix(least[:, 0] * V.P1 + least[:, 1] + np.arange(BANDS, dtype=V.U))
            names += [i] * BANDS
            keys.append(V.signed(key))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())], names=["node", "key"])


def alike(texts: DataFrame, least: float, asked: DataFrame | None = None) -> DataFrame:
    """(node, other) of distinct masked texts (node, text): all pairs that share a band and are verified as this similar
    by their words, in both directions, and each text with itself; with ``asked`` (node) only what is alike to these."""
    keys = checkpointed(texts.mapInArrow(_bands, "node long, key long"))
    others = keys.withColumnRenamed("node", "other")
    if asked is None:
        pairs = keys.join(others, "key").where("node < other")
    else:
        pairs = keys.join(asked, "node", "left_semi").join(others, "key").where("node <> other")
    pairs = pairs.select("node", "other").distinct()
    words = texts.select("node", F.array_distinct(F.filter(F.split("text", " "), lambda w: ~w.isin("n", "9"))).alias("w"))
    both = pairs.join(words, "node").join(words.select(F.col("node").alias("other"), F.col("w").alias("v")), "other")
    close = both.where(F.size(F.array_intersect("w", "v")) >= least * F.size(F.array_union("w", "v"))).select("node", "other")
    if asked is not None:
        return close.unionByName(asked.select("node", F.col("node").alias("other")))
    ends = F.array(F.struct("node", "other"), F.struct(F.col("other").alias("node"), F.col("node").alias("other")))
    return close.select(F.inline(ends)).unionByName(texts.select("node", F.col("node").alias("other")))


def prompt_clusters(prompts: DataFrame) -> DataFrame:
    """(node, cluster) of distinct masked prompts (node, text): the least of what is alike, passed on twice."""
    near = checkpointed(alike(prompts, ALIKE_PROMPTS))
    least = near.groupBy("node").agg(F.min("other").alias("least"))
    passed = near.join(least.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("least").alias("least"))
    return passed.join(least.select(F.col("node").alias("least"), F.col("least").alias("cluster")), "least").select("node", "cluster")


def refusals(features: DataFrame) -> DataFrame:
    """(template, verbatim) of the first sentences that recur across unrelated prompts and say nothing of their own."""
    node = F.xxhash64
    usable = features.where("template is not null and (kind is null or kind <> 'copied')")
    prompts = usable.select(node("prompt").alias("node"), F.col("prompt").alias("text")).distinct()
    uses = usable.select("template", "verbatim", "own", node("prompt").alias("node")).groupBy("template", "verbatim", "own", "node").agg(F.count("*").alias("n"))
    uses = uses.join(prompt_clusters(prompts), "node").groupBy("template", "verbatim", "own", "cluster").agg(F.sum("n").alias("n"))
    uses = checkpointed(uses)
    again = uses.groupBy("verbatim").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a < b").select("verbatim", F.lit(True).alias("again"))
    uses = uses.join(again, "verbatim", "left").withColumn("own", F.col("own") & F.col("again").isNull()).drop("again")
    uses = checkpointed(uses.withColumn("node", node("template")))
    by_template = uses.groupBy("node", "cluster").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("own"))
    texts = uses.select("node", F.col("template").alias("text")).distinct()
    asked = uses.where("not own").select("node").distinct()
    near = alike(texts, ALIKE, asked)
    spread = near.join(by_template.withColumnRenamed("node", "other"), "other").groupBy("node", "cluster").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    spread = spread.groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("own").alias("own"))
    chosen = spread.where((F.col("n") >= LEAST_ROWS) & (F.col("most") <= MOST_SHARE * F.col("n")) & (F.col("own") <= MOST_OWN * F.col("n")))
    real = F.size(F.filter(F.split("template", " "), lambda w: ~w.isin("n", "9")))
    return uses.where(~F.col("own") & (real >= LEAST_WORDS)).join(chosen.select("node"), "node", "left_semi").select("template", "verbatim").distinct()


def defects(
    df: DataFrame, profiles: Profiles, id: str = "qa_id", question: str = "answerable", other: str = "unanswerable", answer: str = "answer", context: str | None = "context"
) -> DataFrame:
    """(id, defect) of every pair, defect null where it is sound. ``profiles``: of the languages, as language.fit gives."""
    rows = df.select(df[id].alias("id"), df[question].alias("q"), df[other].alias("u"), df[answer].alias("a"), (df[context] if context else F.lit(None).cast("string")).alias("c"))
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # a table of fixed size
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, kind string, template string, verbatim string, prompt string, own boolean"
    features = checkpointed(rows.dropDuplicates(["id", "q", "u", "a"]).mapInArrow(_features(shared), schema))
    found = refusals(features).withColumn("refusal", F.lit(True))
    joined = features.join(found, ["template", "verbatim"], "left")
    defect = F.when(F.col("kind").isin("empty", "copied"), F.col("kind")).when(F.col("refusal"), F.lit("refusal")).otherwise(F.col("kind"))
    return joined.select("id", defect.alias("defect"))
