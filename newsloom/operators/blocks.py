"""Pages as typed blocks, and values taken from pages by class, meta name or attribute."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_text

TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}
NARRATIVE = {"p", "blockquote", "div", "td", "article", "section", "main"}
ITEMS = {"li", "dd", "dt"}
SKIPPED = {"script", "style", "noscript", "template", "head"}
INLINE = {"a", "b", "i", "u", "em", "strong", "small", "sub", "sup", "span", "font", "abbr", "cite", "code", "mark", "q", "s", "time", "label"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.out: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.skipped = 0

    def flush(self):
        t = " ".join("".join(self.text).split())
        self.text = []
        if t:
            self.out.append((self.stack[-1] if self.stack else "", t))

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += 1
        elif tag not in INLINE:
            self.flush()
            if tag not in ("br", "hr", "img", "meta", "link", "input"):
                if tag in ("p", "li") and tag in self.stack[-1:]:
                    self.stack.pop()
                self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag not in INLINE:
            self.flush()
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of each run of text between block tags, in order."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


def kind_of(tag: str, text: str) -> str:
    if tag in TITLES:
        return "Title"
    if tag in ITEMS:
        return "ListItem"
    return "NarrativeText" if tag in NARRATIVE and text.rstrip()[-1:] in ".!?…\"”'’)" else "UncategorizedText"


def typed_blocks(pages: DataFrame, id: str, html: str) -> DataFrame:
    """(id, n, tag, kind, text): headings are titles, paragraphs that end as sentences narrative."""

    @F.pandas_udf("array<struct<tag:string,kind:string,text:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [{"tag": t, "kind": kind_of(t, x), "text": x} for t, x in blocks_of(h)])

    return pages.select(F.col(id).alias("id"), F.posexplode(run(F.col(html))).alias("n", "b")).select("id", "n", "b.*")


def worth_keeping(kind: Column, text: Column) -> Column:
    """A title or narrative of at least three words and without a bar."""
    words = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))
    return kind.isin("Title", "NarrativeText") & (words >= 3) & ~text.contains("|")


def heading(kind: Column, text: Column) -> Column:
    return F.when(kind == "Title", F.concat(F.lit("## "), normalize_text(text))).otherwise(normalize_text(text))


def assembled(blocks: DataFrame) -> DataFrame:
    """(id, body): the blocks worth keeping, an empty line between them; as many as a page has."""
    kept = blocks.where(worth_keeping(F.col("kind"), F.col("text"))).select("id", F.struct("n", heading(F.col("kind"), F.col("text")).alias("t")).alias("b"))
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "\n\n").alias("body"))


def first_by_class(html: Column, tag: str, classes: tuple[str, ...], start: str = "") -> Column:
    """Text of the first element of a tag with one of these classes that starts so; null if there is none."""
    inner = F.regexp_extract(html, rf"(?s)<{tag}\b[^>]*\bclass=[\"']?(?:{'|'.join(classes)})[\"']?[^>]*>({start}[^<]*)</{tag}>", 1)
    return F.nullif(normalize_text(inner), F.lit(""))


def attribute(html: Column, tag: str, by: str, value: str, wanted: str) -> Column:
    """An attribute of the first element of a tag of which another has this value (a name, a data-testid)."""
    return F.nullif(F.regexp_extract(html, rf"<{tag}\b(?=[^>]*\b{by}=[\"']{value}[\"'])[^>]*\b{wanted}=[\"']([^\"']*)[\"']", 1), F.lit(""))


