"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense.
WS = r"(?U)\s"
# Markers of refusals, yes and no in their usual forms, the answer that means none is possible.
REFUSAL_MARKERS = ("not possible", "cannot answer")
YES_NO = ("no", "yes", "Yes", "No", "No,", "Yes,", "No.", "Yes.", "yes.", "no.")
IMPOSSIBLE = "Impossible to answer with given information"
STOPWORDS = tuple(
    "a an and are as at be but by for from has have he her his if in into is it its no not of on or our she such that the "
    "their then there these they this to was we were which will with you".split()
)


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Every run of white space as one blank, ends stripped."""
    return strip(F.regexp_replace(c, WS + "+", " "))


def collapse_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n+", "\n"))


def tokens(c: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(c), WS + "+"), lambda t: t != "")


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def strip_intro(body: Column, source: Column, only: str) -> Column:
    """For one source, the text after the first " - "; all else as it is."""
    at = F.instr(body, " - ")
    return F.when((source == only) & (at > 0), F.substring(body, at + 3, F.length(body))).otherwise(body)


def strip_citations(c: Column) -> Column:
    """Without markers such as [12]."""
    return F.regexp_replace(c, r"\[\d+\]", "")


def clean_bullets(c: Column) -> Column:
    """Without bullets that hold nothing before the next one."""
    return F.regexp_replace(c, r"\*[\s\n]*(?=\*)", " ")


def split_bullets(c: Column) -> Column:
    """(headline, points): the text before the first bullet line and the bullets."""
    parts = F.split(c, r"\n\*")
    return F.struct(strip(parts[0]).alias("headline"), F.transform(F.slice(parts, 2, F.size(parts)), strip).alias("points"))


def consolidate_summary(items: Column) -> Column:
    """(summary_type, summary) of extracted items: one is plain text, or none if it is empty; else bullets."""
    first = F.try_element_at(items, F.lit(1))
    bullets = F.array_join(F.transform(items, lambda x: F.concat(F.lit("* "), x, F.lit("\n"))), "")
    kind = F.when(F.size(items) == 1, F.when(first == "", "NULL").otherwise("PLAIN")).otherwise("BULLETS")
    return F.struct(kind.alias("summary_type"), F.when(F.size(items) == 1, first).otherwise(bullets).alias("summary"))


# The characters that the two versions of Markdown read.
MARKDOWN = {1: r"[_*`\[]", 2: r"[_*\[\]()~`>#+\-=|{}.!]"}


def markdown_escape(c: Column, version: int = 2) -> Column:
    """Backslashes before the characters that this version of Markdown reads, and a full-width dollar sign."""
    return F.replace(F.regexp_replace(c, f"({MARKDOWN[version]})", r"\\$1"), F.lit("$"), F.lit("＄"))


def ticker_forms(c: Column) -> Column:
    """A ticker with a class, such as A.B, and its root A; others alone; empty ones none."""
    return F.when(c.contains("."), F.array(c, F.split(c, r"\.")[0])).when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))


def published_prefix(published: Column, c: Column) -> Column:
    return F.concat(F.lit("Published: "), F.date_format(published, "yyyy-MM-dd"), F.lit("\n"), c)


def between(c: Column, start: str, end: str | None = None) -> Column:
    """What stands between two markers; the dot matches line ends, without recursion in the matcher."""
    tail = rf"\s*{end}" if end else r"\z"
    return F.regexp_extract(c, rf"(?s){start}\s*(.+?)\s*{tail}", 1)


def alpha_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda w: w.rlike("^[A-Za-z]+$")))


def digit_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def numbered_items(c: Column) -> Column:
    """The items of a numbered list."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^\d+\.\s*(.+)$"), F.lit(1))


def sentences(c: Column) -> Column:
    """Sentences with their marks: split behind . ! ? before white space."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def truncate_tokens(c: Column, budget: int) -> Column:
    """The first ``budget`` tokens between blanks."""
    return F.array_join(F.slice(F.split(c, " "), 1, budget), " ")


def comma_items(c: Column) -> Column:
    """The items of a list with commas, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def json_object(c: Column, schema: str) -> Column:
    """The object between the first brace and the last, by a schema; null where it is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)


def within_budget(c: Column, prompt: Column, most: int, buffer: int = 20) -> Column:
    """As many tokens of ``c`` as ``prompt`` leaves of ``most``, less a buffer; none if it leaves none."""
    room = F.greatest(F.lit(most - buffer) - F.size(F.split(prompt, " ")), F.lit(0))
    return F.array_join(F.slice(F.split(c, " "), F.lit(1), room), " ")


def inner_slice(c: Column, n: int) -> Column:
    """Without ``n`` characters at both ends."""
    return F.substring(c, F.lit(n + 1), F.greatest(F.length(c) - 2 * n, F.lit(0)))


def chat(system: Column, user: Column, answer: Column) -> Column:
    """One turn in a chat template."""
    return F.concat(F.lit("[INST] <<SYS>>\n"), system, F.lit("\n<</SYS>>\n"), user, F.lit(" [/INST] "), answer)


def ended(c: Column, bos: str, eos: str) -> Column:
    """Without the mark of the beginning, with that of the end once."""
    begun = F.when(c.startswith(bos), F.substring(c, F.lit(len(bos) + 1), F.length(c))).otherwise(c)
    return F.when(begun.endswith(eos), begun).otherwise(F.concat(begun, F.lit(eos)))
