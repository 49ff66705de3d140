"""Pages: links, frontier, extraction by a registry of column expressions, validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_text


def links(html: Column, url: Column) -> Column:
    """Distinct targets of a page's links, relative ones resolved against its address, without a last # or /."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    bare = F.transform(found, lambda x: F.trim(F.regexp_replace(x, "^[\"']|[\"']$", "")))
    full = F.transform(bare, lambda x: resolved(x, url))
    return F.array_distinct(F.filter(F.transform(full, lambda x: F.regexp_replace(x, "[#/]$", "")), lambda x: x != ""))


def resolved(link: Column, base: Column) -> Column:
    """``link`` as seen from the page at ``base``: absolute as it is, else by scheme, host, folder or page."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    page = F.regexp_replace(base, "#.*$", "")
    query = F.regexp_extract(link, r"([?#].*)$", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    whole = F.when(link.startswith("/"), F.regexp_replace(link, "[?#].*$", "")).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_replace(link, "[?#].*$", "")))
    parts = F.split(whole, "/")
    up = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    walked = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), up)
    ends = F.when(F.element_at(parts, -1).isin("..", "."), "/").otherwise("")
    return (
        F.when(link.rlike(r"^[A-Za-z][\w+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link == "", page)
        .when(link.startswith("#"), F.concat(page, link)).when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, F.array_join(walked, "/"), ends, query))
    )


def allowed(link: Column, prefixes: list[str]) -> Column:
    """Whether a link starts as one of these patterns."""
    return F.lit(False) if not prefixes else link.rlike("^(?:" + "|".join(prefixes) + ")")


def permitted(links: DataFrame, rules: DataFrame, link: str = "link") -> DataFrame:
    """Links that a site's robots may take: rules are (host, prefix, allow); the longest prefix that fits decides, on a tie
    the one that allows; a site without rules allows all."""
    parts = links.withColumn("__host", F.lower(F.regexp_extract(link, r"^[a-z]+://([^/?#:]+)", 1))).withColumn("__path", F.regexp_replace(link, r"^[a-z]+://[^/?#]*", ""))
    path = F.when(F.col("__path").startswith("/"), F.col("__path")).otherwise(F.concat(F.lit("/"), "__path"))
    r = rules.select(F.lower("host").alias("__host"), "prefix", "allow").distinct()
    hit = parts.join(r, "__host").where(path.startswith(F.col("prefix")))
    said = hit.groupBy(link).agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("__allow")).where("not __allow")
    return links.join(said, link, "left_anti")


def frontier(pages: DataFrame, seen: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(link): targets of ``pages`` that are not in ``seen`` (link)."""
    found = pages.select(F.explode(links(F.col(html), F.col(url))).alias("link")).distinct()
    return found.join(seen, "link", "left_anti")


def meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'<meta name="{name}" content="([^"]*)"', 1), F.lit(""))


def first_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(normalize_text(F.regexp_replace(inner, r"<[^>]*>", "")), F.lit(""))


@dataclass
class Registry:
    """Extractors of one kind of site, applied in order of registration."""

    extractors: list[tuple[str, bool, Callable[[Column], Column]]] = field(default_factory=list)

    def extractor(self, name: str, required: bool = True):
        def add(f: Callable[[Column], Column]):
            self.extractors.append((name, required, f))
            return f

        return add

    def extract(self, pages: DataFrame, html: str = "html") -> DataFrame:
        """``pages`` without html but with the extracted columns. A page that lacks a required one is dropped, an
        optional one that fails is null."""
        out = pages.select("*", *[f(F.col(html)).alias(name) for name, _, f in self.extractors])
        for name, required, _ in self.extractors:
            out = out.where(F.col(name).isNotNull()) if required else out
        return out.drop(html)


NEWS = Registry()
NEWS.extractor("headline")(lambda h: first_text(h, "h1"))
NEWS.extractor("stamp", required=False)(lambda h: meta(h, "article:published_time"))
NEWS.extractor("page_title", required=False)(lambda h: first_text(h, "title"))
