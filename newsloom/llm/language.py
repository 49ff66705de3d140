"""Language of documents and of each stretch of text in one language, with a confidence.

Hyperdimensional profiles: every letter has a random vector of DIMENSION signs; a run of three letters is
the product of its letters' vectors, each permuted by its place; a text is the sum of its runs, and so is
the prototype of a language over its training text. A stretch takes the language whose centred prototype
it has the greatest cosine with. Since the sum is linear, the product of every run with every prototype is
tabulated once, and texts are scored by look-ups in whole batches. A text's norm uses that the vectors of
different runs are orthogonal but for noise of the order 1 / sqrt(DIMENSION).

The prototypes are fitted on a bounded sample: at most SAMPLE labelled documents of a language, chosen by a
hash of the id, and the sentences in SEEDS, so that a language without labelled rows has one too. Labels are
noisy, so documents that the first fit puts elsewhere are left out of the second. The fit is a table of
a fixed size (6 MB), sent to every executor; everything else covers all texts whole.

Stretches are sentences, or parts of a line between them; neighbours of one language are joined. A stretch too
close to call takes that of its two nearest languages of which its document has more. The language of a line is that of most of its words. Words are runs of two or more letters that touch no digit and are in
no address.

Text in another script is of language und, with confidence 0; another language in Latin letters is taken for the nearest.

Cases: null and empty texts have no stretches and a null language; lines without words do not count; ties
between languages go to the one that comes first in the line; a single short word is judged too, with a low
confidence; repeated rows are judged each; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import textvec as V
from newsloom.llm.similarity import slices

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")
#: Most labelled documents per language that the prototypes are fitted on, and their longest text.
SAMPLE, SAMPLE_CHARS = 400, 4000
DIMENSION = 8192
#: Code of stretches in another script than that of LANGUAGES, with confidence 0.
UNKNOWN = "und"
#: Confidence below which a stretch is too close to call by itself.
CLOSE = 0.65

# Two- and three-letter ISO 639 codes and English names.
LABELS = {
    "de": "de deu ger german", "en": "en eng english", "es": "es spa spanish", "fr": "fr fra fre french",
    "it": "it ita italian", "nl": "nl nld dut dutch", "pt": "pt por portuguese",
}

SEEDS = {
    "de": "Der Vorstand und die Mitarbeiter haben sich nicht auf einen neuen Vertrag geeinigt, weil die Kosten für das Unternehmen zu hoch sind. Im vergangenen Jahr stieg der Gewinn, wie es am Montag hieß, auch wenn viele Kunden noch warten und mit besseren Preisen rechnen.",
    "en": "The board and the workers have not agreed on a new contract because the costs would be too high for the company. Last year the profit rose, it said on Monday, even though many of its customers are still waiting and expect that prices will get better.",
    "es": "El consejo y los trabajadores no han llegado a un acuerdo sobre el nuevo contrato, porque los costes son demasiado altos para la empresa. El año pasado subió el beneficio, según dijo el lunes, aunque muchos de sus clientes todavía esperan que mejoren los precios.",
    "fr": "Le conseil et les salariés ne se sont pas mis d'accord sur un nouveau contrat, parce que les coûts sont trop élevés pour l'entreprise. L'année dernière, le bénéfice a augmenté, a-t-elle dit lundi, même si beaucoup de ses clients attendent encore de meilleurs prix.",
    "it": "Il consiglio e i lavoratori non hanno trovato un accordo sul nuovo contratto, perché i costi sono troppo alti per la società. L'anno scorso l'utile è aumentato, ha detto lunedì, anche se molti dei suoi clienti aspettano ancora che i prezzi migliorino.",
    "nl": "De raad en het personeel zijn het niet eens geworden over een nieuw contract, omdat de kosten voor het bedrijf te hoog zijn. Vorig jaar steeg de winst, zo bleek op maandag, ook al wachten veel van zijn klanten nog en verwachten zij dat de prijzen beter worden.",
    "pt": "O conselho e os trabalhadores não chegaram a acordo sobre o novo contrato, porque os custos são demasiado altos para a empresa. No ano passado o lucro subiu, disse na segunda-feira, embora muitos dos seus clientes ainda esperem que os preços melhorem.",
}

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + " " + "'" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SPACE, OTHER, K = 26, len(_LETTERS), len(_LETTERS) + 1


def _symbols() -> np.ndarray:
    table = np.full(0x110000, SPACE, np.uint8)
    table[V.alnum()] = OTHER
    table[[c for c in range(0x3000) if chr(c).isnumeric()]] = SPACE
    for i, c in enumerate(_LETTERS):
        table[ord(c)] = i
    table[ord("’")] = _LETTERS.index("'")
    return table


_TABLE: np.ndarray | None = None
_BREAK = re.compile(r"(?<=[.!?…;:»”\"’'“)])\s+(?=[^a-z])|(?<=[.!?…])\s+")
_ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+|\S+@\S+")
_WORD = re.compile(r"(?<!\w)[^\W\d_]{2,}(?!\w)")
_FIRST = re.compile(r"[^\w]*([^\W\d_]+)(?=\s+[a-zà-öø-ÿ])")
_NAME = re.compile(r"(?<!\w)[^\W\d_a-zà-öø-ÿß][\w’'&-]*")


def telling(text: str) -> str:
    """``text`` without its capitalised words, if three others remain: they are mostly names, the same in
    all languages. A capitalised word that only begins the text stays, and texts in capitals stay whole."""
    first = _FIRST.match(text)
    at = first.end(1) if first else 0
    plain = text[:at] + _NAME.sub(" ", text[at:])
    return plain if len(_WORD.findall(plain)) >= 3 else text


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the three-letter run that ends at each symbol, and the offsets of the texts; runs do not
    cross texts, and white space and all else that is no letter is one blank."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _symbols()
    cp, off = V.points(["  " + t.lower() + " " for t in texts])
    s = _TABLE[cp].astype(np.int64)
    keep = np.ones(len(s), bool)
    keep[2:] = ~((s[2:] == SPACE) & (s[1:-1] == SPACE) & (s[:-2] == SPACE))
    start = off[:-1]
    keep[start] = keep[start + 1] = True
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    s = s[keep]
    g = np.zeros(len(s), np.int64)
    g[2:] = (s[:-2] * K + s[1:-1]) * K + s[2:]
    head = at[:-1]
    g[head] = g[np.minimum(head + 1, max(len(g) - 1, 0))] = (SPACE * K + SPACE) * K + SPACE
    return g, at


def run_counts(texts: list[str]) -> np.ndarray:
    g, _ = encode(texts)
    n = np.bincount(g, minlength=K**3).astype(np.float64)
    n[(SPACE * K + SPACE) * K + SPACE] = 0
    return n


def _letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    signs = np.random.RandomState(20240917).randint(0, 2, (K, DIMENSION)).astype(np.float32) * 2 - 1
    return np.roll(signs, 2, 1), np.roll(signs, 1, 1), signs


def bundle(counts: np.ndarray) -> np.ndarray:
    """Sum of the vectors of the runs, each as often as it is counted."""
    first, second, third = _letter_vectors()
    out = np.zeros(DIMENSION, np.float64)
    some = np.flatnonzero(counts)
    for i in range(0, len(some), 4096):
        g = some[i : i + 4096]
        v = first[g // (K * K)] * second[g // K % K] * third[g % K]
        out += counts[g] @ v
    return out


class Profiles:
    """Tabulated products of every run of three letters with every language's centred prototype."""

    def __init__(self, counts: dict[str, np.ndarray]):
        prototypes = np.stack([bundle(np.sqrt(counts[x])) for x in LANGUAGES])
        prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
        prototypes -= prototypes.mean(0)
        prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
        first, second, third = _letter_vectors()
        table = np.zeros((K, K * K, len(LANGUAGES)), np.float32)
        for i in range(0, DIMENSION, 1024):  # slices of the dimensions, for memory
            a, b, c = (x[:, i : i + 1024] for x in (first, second, third))
            pairs = (b[:, None] * c[None]).reshape(K * K, -1).T
            for j, p in enumerate(prototypes[:, i : i + 1024].astype(np.float32)):
                table[:, :, j] += (a * p) @ pairs
        self.table = table.reshape(K**3, len(LANGUAGES))
        self.table[(SPACE * K + SPACE) * K + SPACE] = 0

    def cosines(self, texts: list[str]) -> np.ndarray:
        """(texts, languages), in blocks of about 300,000 characters."""
        upto = np.cumsum([len(t) for t in texts]) // 300_000
        ends = [*(np.flatnonzero(np.diff(upto)) + 1), len(texts)] if texts else []
        parts = [self._cosines(texts[i:j]) for i, j in zip([0, *ends], ends)]
        return np.concatenate(parts) if parts else np.empty((0, len(LANGUAGES)), np.float32)

    def _cosines(self, texts: list[str]) -> np.ndarray:
        g, off = encode(texts)
        total = np.add.reduceat(self.table[g], np.minimum(off[:-1], len(g) - 1), axis=0)
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        key = np.sort(doc * K**3 + g)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(new, len(key))).astype(np.float64)
        blank = key[new] % K**3 == (SPACE * K + SPACE) * K + SPACE
        square = np.bincount(key[new] // K**3, np.where(blank, 0, n * n), len(texts))
        return (total / np.sqrt(np.maximum(square, 1) * DIMENSION)[:, None]).astype(np.float32)


def label_language(label: Column) -> Column:
    """The two-letter code that a label denotes, null where it denotes none of LANGUAGES."""
    x = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    code = F.regexp_replace(x, r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})+$", "$1")
    pairs = [v for two, names in LABELS.items() for n in names.split() for v in (F.lit(n), F.lit(two))]
    return F.try_element_at(F.create_map(*pairs), code)


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from a bounded sample of labelled rows and the seeds."""
    rows = df.select(df[text].alias("text"), label_language(df[lang]).alias("lang"), F.xxhash64(df[id], df[text]).alias("order"))
    rows = rows.where("text is not null and lang is not null").where(F.length("text") <= SAMPLE_CHARS)
    w = Window.partitionBy("lang").orderBy("order")  # Spark keeps the first SAMPLE of each task before it shuffles
    chosen = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SAMPLE)
    sample = [(telling(r["text"]), r["lang"]) for r in chosen.collect()]  # at most SAMPLE rows a language
    profiles = Profiles({x: run_counts([SEEDS[x]] * 3) for x in LANGUAGES})
    for _ in range(2):
        texts = [[SEEDS[x]] * 3 for x in LANGUAGES]
        best = profiles.cosines([t for t, _ in sample]).argmax(1) if sample else []
        for (t, x), b in zip(sample, best):
            if LANGUAGES[b] == x:
                texts[b].append(t)
        profiles = Profiles({x: run_counts(texts[i]) for i, x in enumerate(LANGUAGES)})
    return profiles


def foreign(text: str) -> bool:
    """Whether most letters are of another script than the Latin one, in which all LANGUAGES are written."""
    if text.isascii():
        return False
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(ord(c) > 0x24F and not 0x1E00 <= ord(c) <= 0x1EFF for c in letters) > len(letters)


def n_words(text: str) -> int:
    return len(_WORD.findall(_ADDRESS.sub(" ", text)))


def stretches(text: str) -> list[tuple[int, str, int]]:
    """(line number, stretch, words) of the parts with words, in order."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if not line.strip():
            continue
        line = _ADDRESS.sub(" ", line) if "//" in line or "@" in line or "www." in line else line
        parts = []
        for s in _BREAK.split(line):
            n = len(_WORD.findall(s))
            if parts and (n < 4 or parts[-1][1] < 4):  # too short to judge alone
                parts[-1] = (parts[-1][0] + " " + s, parts[-1][1] + n)
            else:
                parts.append((s, n))
        out += [(i, s, n) for s, n in parts if n]
    return out


def settled(doc: np.ndarray, words: np.ndarray, c: np.ndarray, best: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """``best``, but a stretch too close to call takes that of its two nearest languages of which the rest of its
    document has more words."""
    close = np.flatnonzero(sure < CLOSE)
    if not len(close):
        return best
    rest = np.zeros((int(doc.max()) + 1, len(LANGUAGES)))
    clear = sure >= CLOSE
    np.add.at(rest, (doc[clear], best[clear]), words[clear])
    out = best.copy()
    for i in close:
        second, first = np.argsort(c[i])[-2:]
        if rest[doc[i], second] > rest[doc[i], first]:
            out[i] = second
    return out


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for b in slices(batches, 200):
            doc, line, words, flat = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, s, w in stretches(t or ""):
                    doc.append(i)
                    line.append(n)
                    words.append(w)
                    flat.append(s)
            c = profiles.cosines([telling(x) for x in flat])
            top = np.sort(c, 1)
            best = c.argmax(1) if len(flat) else np.empty(0, np.int64)
            margin = top[:, -1] - top[:, -2] if len(flat) else np.empty(0)
            sure = 1 / (1 + np.exp(-12.0 * margin * np.sqrt(np.maximum(words, 1) / 4))) if len(flat) else np.empty(0)
            best = settled(np.asarray(doc, np.int64), np.asarray(words, np.int64), c, best, sure)
            other = np.array([foreign(x) for x in flat], bool)
            sure = np.where(other, 0.0, sure)
            lang = pa.array(np.where(other, UNKNOWN, np.array(LANGUAGES)[best]) if len(flat) else [], pa.string())
            seq = np.arange(len(flat)) - np.searchsorted(doc, doc) if len(flat) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(doc, pa.int64())), pa.array(line, pa.int32()), pa.array(seq.astype(np.int32)),
                    pa.array(words, pa.int32()), lang, pa.array(np.asarray(sure, np.float64)),
                ],
                names=["id", "line_no", "part", "words", "lang", "confidence"],
            )

    return run


def judged(df: DataFrame, profiles: Profiles, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, part, words, lang, confidence) of every stretch, part counting them in the document."""
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # a table of fixed size
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(df[id].alias("id"), df[text].alias("text")).where("text is not null")
    return rows.mapInArrow(_judge(shared), f"id {kind}, line_no int, part int, words int, lang string, confidence double")


def _most(parts: DataFrame, *keys: str) -> DataFrame:
    """The language of most words per key, the earlier one on ties, and its word-weighted confidence."""
    each = parts.groupBy(*keys, "lang").agg(
        F.sum("words").alias("words"), F.min("part").alias("at"), F.sum(F.col("words") * F.col("confidence")).alias("sure")
    )
    best = F.max_by(F.struct("lang", "words", "sure"), F.struct("words", -F.col("at")))
    return each.groupBy(*keys).agg(best.alias("best"), F.sum("words").alias("words")).select(
        *keys, F.col("best")["lang"].alias("lang"), (F.col("best")["sure"] / F.col("words")).alias("confidence"), "words"
    )


def line_languages(parts: DataFrame) -> DataFrame:
    """(id, line_no, lang, confidence, words) of the lines with words."""
    return _most(parts, "id", "line_no")


def document_languages(parts: DataFrame) -> DataFrame:
    """(id, lang, confidence, words) of the documents with words."""
    return _most(parts, "id")


def segments(parts: DataFrame) -> DataFrame:
    """(id, segment, first_line, last_line, lang, confidence, words): neighbours of one language joined.

    The window runs over the stretches of one document.
    """
    w = Window.partitionBy("id").orderBy("part")
    changed = F.coalesce((F.col("lang") != F.lag("lang").over(w)).cast("int"), F.lit(0))
    numbered = parts.withColumn("changed", changed).withColumn("segment", F.sum("changed").over(w).cast("int"))
    return numbered.groupBy("id", "segment").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.first("lang").alias("lang"),
        (F.sum(F.col("words") * F.col("confidence")) / F.sum("words")).alias("confidence"), F.sum("words").alias("words"),
    )
