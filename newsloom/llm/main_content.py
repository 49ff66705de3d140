"""The main body of web pages, by removing the template of their site.

Every page is parsed into its element tree, and every element's subtree is hashed bottom-up from its tag, the texts in
it (folded to letters; a text that is wholly a link, and the page's own headline within a text, are left open) and
the hashes of its children. The pages of a host that hold the same subtree are counted in Spark, and subtrees recurring
in at least RECURS different contents of the host, and in RECURS_SHARE of all its contents, are template.
Pages with the same headline or the same longest paragraph hold one content, so copies of an article, however many, do
not make its paragraphs template.

Deletion starts from the recurring subtrees. What recurs nowhere and reads like sentences is the page's own prose;
the innermost element with most of it is never deleted as a whole. Of what stands beside that element, each largest
subtree with a recurring one in it goes, whatever else fills it on this page; and so do those in a place of the host's
tree (the tags from the root, before or after the article) at which such subtrees recur in as many contents. Within
the element, recurring subtrees go that neither stand between the first and the last paragraph nor directly at its ends
(cookie notices and footers, where the body is the whole page), and recurring subtrees that are nothing but a link
(teasers and advertisement slots, which change from page to page but not in shape). Recurring
subtrees between or directly at the ends of the paragraphs that are not links (bylines, agency notes, notices) belong
to the article and stay. Where nothing recurs, nothing is deleted.

Cases: rows without html have no template to remove and give no lines; a page without prose keeps its
largest element by words that are no link; markup that is never closed, stray end tags, comments, scripts
and styles are tolerated, and elements may be nested to any depth; a page without a host is counted under its source, without either under
none; the same page delivered again counts once per id; empty tables give empty results; only the
named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textvec as V
from newsloom.llm.similarity import slices
from newsloom.session import checkpointed

#: A subtree is template if it stands in at least so many contents of its host, and in this share of them.
RECURS = 5
RECURS_SHARE = 0.005
#: The body is the innermost element that holds at least this share of the prose.
SHARE = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)",
    re.S | re.I,
)
_VOID = frozenset("br hr img input meta link wbr area base col embed source track param !doctype".split())
_INLINE = frozenset("a b i u em strong small sub sup abbr cite code mark time q s font label".split())
# A start tag closes these open elements when they are the innermost block.
_CLOSES = {
    "li": {"li", "p"}, "p": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
}
_BLOCK_CLOSES = {"p"}

# At the ends of the article, subtrees below these are not of it; an element of these tags is a page, not an article.
_AROUND = frozenset("nav footer aside header form".split())
_PAGE_TAGS = frozenset(["", "html", "body"])

LINK, SENTENCE = 1, 2


def tree(html: str) -> tuple[list[int], list[str], list[tuple[int, str, bool, int]], str]:
    """(parent of each element, tag of each element, blocks, headline: the first h1, else the title). A block is
    (element, text, whether all its text is a link, how many elements began before it)."""
    parent, tags, stack, blocks, head = [-1], [""], [(0, "")], [], []
    text, linked, links, in_head = [], True, 0, False

    def flush():
        nonlocal linked
        if text:
            t = "".join(text)
            text.clear()
            if t.strip():
                blocks.append((stack[-1][0], unescape(t) if "&" in t else t, linked, len(parent)))
        linked = True

    for m in _TOKEN.finditer(html):
        _, close, tag, _, piece = m.groups()
        if piece is not None:
            if in_head:
                head.append(piece)
            else:
                text.append(piece)
                if not links and not piece.isspace():
                    linked = False
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = max(0, links - 1) if close else links + 1
            continue
        if tag in ("head", "title"):
            in_head = not close
            continue
        if tag in _INLINE:
            continue
        flush()
        if tag in _VOID:
            continue
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] == tag:
                    del stack[i:]
                    links = 0
                    break
            continue
        in_head = False
        shut = _CLOSES.get(tag, _BLOCK_CLOSES)
        while len(stack) > 1 and stack[-1][1] in shut:
            stack.pop()
            links = 0
        parent.append(stack[-1][0])
        tags.append(tag)
        stack.append((len(parent) - 1, tag))
    flush()
    headline = next((t for e, t, _, _ in blocks if tags[e] == "h1"), None)
    return parent, tags, blocks, unescape("".join(head)) if headline is None else headline


def _fold(texts: list[str], digits: bool) -> np.ndarray:
    """Hash of each text folded to letters and digits, or to letters; 0 where nothing is left."""
    low = V.lowered(texts)
    cp, off = V.points(low)
    keep = V.alnum()[cp]
    if not digits:
        keep &= ~((cp >= 48) & (cp <= 57))
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    h = V.span_hashes(cp[keep], at[:-1], at[1:])
    h[at[1:] == at[:-1]] = V.U(0)
    return V.signed(h)


_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s*$")
_PAGE = "row long, host string, id string, parent array<int>, element array<int>, flags array<int>, words array<int>, tags array<string>, runs array<long>, subtrees array<long>, text array<long>, line_no array<int>, line array<long>, headline long, lead long"


def _lists(counts: list[int], values, type) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type))


_M64, _K = (1 << 64) - 1, int(V.P1)


def _name(tag: str) -> int:
    return zlib.crc32(tag.encode()) * _K & _M64


_OPEN = _name("a text that is a link")


def subtree_hashes(parent: list[int], tags: list[str], blocks: list[tuple[int, str, bool, int]], texts: list[int]) -> tuple[list[int], list[int]]:
    """(hash of each block's text, hash of each element's subtree), unsigned; 0 where there is no text.

    An element's hash runs over its tag and, in the order of the page, its texts and its children's hashes. One whose
    only content is one text has the hash of that text.
    """
    names = {}
    for t in tags:
        if t not in names:
            names[t] = _name(t)
    content: list[list] = [[] for _ in parent]
    runs = []
    for (e, _, linked, begun), x in zip(blocks, texts):
        # A text is a subtree of its own, whatever holds it; one that is a link has only its place.
        runs.append((_OPEN * _K ^ names[tags[e]]) & _M64 if x and linked else x)
        if x:
            content[e].append((2 * begun, runs[-1]))
    subtrees = [0] * len(parent)
    for e in range(len(parent) - 1, -1, -1):  # children come after their parents
        held = content[e]
        if not held:
            continue
        if len(held) == 1 and not held[0][0] & 1:
            h = held[0][1]
        else:
            h = names[tags[e]]
            for _, x in sorted(held):
                h = ((h ^ x) * _K + (h >> 29)) & _M64
        subtrees[e] = h
        if e:
            content[parent[e]].append((2 * e + 1, h))
    return runs, subtrees


def _signed_list(values: list[int]) -> np.ndarray:
    return np.array(values, V.U).view(np.int64) if values else np.empty(0, np.int64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 400):
        pages = [tree(html) for html in b.column(3).to_pylist()]
        texts, open_texts, headlines, leads = [], [], [], []
        for _, _, blocks, headline in pages:
            headlines.append(headline)
            texts += [t for _, t, _, _ in blocks]
            open_texts += [t.replace(headline, " ") if len(t) > len(headline) > 8 else t for _, t, _, _ in blocks]
            leads.append(max((t for _, t, linked, _ in blocks if not linked and t.count(" ") > 4 and _SENTENCE.search(t)), key=lambda t: (len(t), t), default=""))
        shapes = _fold(open_texts, False).view(V.U).tolist()
        runs, subtrees, at = [], [], 0
        for parent, tags, blocks, _ in pages:
            r, s = subtree_hashes(parent, tags, blocks, shapes[at : at + len(blocks)])
            runs += r
            subtrees += s
            at += len(blocks)
        n_parents, n_blocks = [len(x[0]) for x in pages], [len(x[2]) for x in pages]
        every = [x for p in pages for x in p[2]]
        bodies = b.column(4).to_pylist()
        cp, doc, line, bounds = V.lines(bodies)
        h = V.signed(V.span_hashes(cp, bounds[:-1], bounds[1:])) if len(doc) else np.empty(0, np.int64)
        n_lines = np.bincount(doc, minlength=b.num_rows).tolist() if len(doc) else [0] * b.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), b.column(2), _lists(n_parents, [x for p in pages for x in p[0]], pa.int32()),
                _lists(n_blocks, [e for e, _, _, _ in every], pa.int32()),
                _lists(n_blocks, [LINK * linked + SENTENCE * (_SENTENCE.search(t) is not None) for _, t, linked, _ in every], pa.int32()),
                _lists(n_blocks, [t.count(" ") + 1 for t in texts], pa.int32()), _lists(n_parents, [x for p in pages for x in p[1]], pa.string()),
                _lists(n_blocks, _signed_list(runs), pa.int64()), _lists(n_parents, _signed_list(subtrees), pa.int64()),
                _lists(n_blocks, _fold(texts, True), pa.int64()), _lists(n_lines, line.astype(np.int32), pa.int32()), _lists(n_lines, h, pa.int64()),
                pa.array(_fold(headlines, True), pa.int64()), pa.array(_fold(leads, True), pa.int64()),
            ],
            names=[x.split()[0] for x in _PAGE.split(", ")],
        )


KEEP, DELETE, OPEN = 0, 1, 2


def judged_blocks(parent, tags, element, flags, words, runs, subtrees, template) -> tuple[list[int], list[int]]:
    """(verdict on each block, hash of the place of the subtree beside the article that it stands in, or 0).

    A verdict is KEEP, DELETE, or OPEN where the page alone does not tell: the block stands beside the article in a
    subtree without a recurring one, and it depends on what stands in this place on the host's other pages.
    """
    n = len(parent)
    below = [subtrees[e] in template for e in range(n)]  # in a recurring subtree
    for e in range(1, n):
        below[e] = below[e] or below[parent[e]]
    recurring = [not x or x in template or below[e] for e, x in zip(element, runs)]

    def heaviest(weight: list[int]) -> int:
        total = [0] * n
        for e, w in zip(element, weight):
            total[e] += w
        best = [-1] * n
        for e in range(n - 1, 0, -1):
            p = parent[e]
            total[p] += total[e]
            if best[p] < 0 or total[e] >= total[best[p]]:
                best[p] = e
        at, everything = 0, total[0]
        while everything:
            c = best[at]
            if c < 0 or total[c] < SHARE * everything or best[c] < 0:
                break
            at = c
        return at if everything else -1

    prose = [w if not r and not f & LINK and f & SENTENCE and w > 5 else 0 for f, w, r in zip(flags, words, recurring)]
    if not any(prose):
        prose = [w if not f & LINK and not r else 0 for f, w, r in zip(flags, words, recurring)]
    if not any(prose):
        prose = [w if not f & LINK else 0 for f, w in zip(flags, words)]
    main = heaviest(prose)
    if main < 0:
        return [DELETE if r else KEEP for r in recurring], [0] * len(element)

    # Elements within the article's, those around it, and for the others the largest subtree beside it.
    inside, around = [False] * n, [False] * n
    e = main
    while e >= 0:
        around[e] = True
        e = parent[e]
    region, place, aside = [-1] * n, [0] * n, [False] * n
    for e in range(n):
        p = parent[e]
        inside[e] = e == main or (p >= 0 and inside[p])
        place[e] = ((place[p] if p >= 0 else 1) * _K ^ _name(tags[e])) & _M64
        if not inside[e] and not around[e]:
            region[e] = e if around[p] else region[p]
        aside[e] = inside[e] and e != main and (tags[e] in _AROUND or aside[p])
    verdict, where = [KEEP] * len(element), [0] * len(element)
    marked = set()
    at = []
    for i, e in enumerate(element):
        at.append(region[e] if region[e] >= 0 else -2 - e if around[e] and e != main else -1)
        if at[i] != -1 and recurring[i] and runs[i]:
            marked.add((at[i], e > main))
    for i, e in enumerate(element):
        if at[i] != -1:
            side = e > main
            spot = place[at[i]] if at[i] >= 0 else place[-2 - at[i]] ^ 1
            where[i] = (spot * 2 + side) & _M64
            verdict[i] = DELETE if (at[i], side) in marked else OPEN
        elif flags[i] & LINK and recurring[i]:
            verdict[i] = DELETE
    keep = [v == KEEP for v in verdict]
    inner = [i for i, (k, w) in enumerate(zip(keep, prose)) if k and w]
    if not inner or all(r or not k for r, k in zip(recurring, keep)):
        return verdict, where  # no paragraph of the page's own: nothing tells the template's text from the article's
    first, last = inner[0], inner[-1]
    # An article's element has paragraphs as its children; elsewhere prose lies scattered, and the page is the body.
    article = tags[main] not in _PAGE_TAGS and any(main in (element[i], parent[element[i]]) for i in inner)
    for end, step in ((first, -1), (last, 1)):
        near = parent[element[end]]
        touching = True
        for i in range(end + step, -1 if step < 0 else len(keep), step):
            if not recurring[i]:
                touching = touching and keep[i]
                continue
            touching = touching and (element[i] == element[end] or (parent[element[i]] == near and near >= 0))
            if keep[i] and not (touching or (article and not aside[element[i]])):
                verdict[i] = DELETE
    return verdict, where


_VERDICT = "row long, host string, id string, headline long, lead long, verdict array<int>, places array<long>, evidence array<long>, lines array<int>, open_lines array<int>, open_places array<long>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 400):
        out = {k: [] for k in ("verdict", "places", "evidence", "lines", "open_lines", "open_places")}
        for r in b.to_pylist():
            verdict, places = judged_blocks(r["parent"], r["tags"], r["element"], r["flags"], r["words"], r["runs"], r["subtrees"], set(r["template"] or ()))
            places = _signed_list(places).tolist()
            texts = r["text"]
            article = {t for t, v in zip(texts, verdict) if v == KEEP}
            outside = {t for t, v in zip(texts, verdict) if v == DELETE and t} - article
            unsure = {t: p for t, v, p in zip(texts, verdict, places) if v == OPEN and t and t not in article and t not in outside}
            out["verdict"].append(verdict)
            out["places"].append(places)
            out["evidence"].append(sorted({p for v, p in zip(verdict, places) if v == DELETE and p}))
            out["lines"].append([n for n, x in zip(r["line_no"], r["line"]) if x in outside])
            late = [(n, unsure[x]) for n, x in zip(r["line_no"], r["line"]) if x in unsure]
            out["open_lines"].append([n for n, _ in late])
            out["open_places"].append([p for _, p in late])
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = {"verdict": ints, "places": longs, "evidence": longs, "lines": ints, "open_lines": ints, "open_places": longs}
        fixed = [b.column(b.schema.get_field_index(c)) for c in ("row", "host", "id", "headline", "lead")]
        yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(out[k], t) for k, t in kinds.items()]], names=[x.split()[0] for x in _VERDICT.split(", ")])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 400):
        out = []
        for html, verdict, places, template in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
            _, _, blocks, _ = tree(html)
            template = set(template or ())
            kept = [t for (_, t, _, _), v, p in zip(blocks, verdict, places) if v == KEEP or (v == OPEN and p not in template)]
            out.append("\n\n".join(" ".join(t.split()) for t in kept))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "main_text"])


def parsed_pages(df: DataFrame, id: str = "id", html: str = "html", url: str = "url", source: str = "source", body: str = "body") -> DataFrame:
    """One compact row per page: its tree, its blocks and the hashes of its body's lines."""
    host = F.lower(F.regexp_extract(df[url], r"^[^/]*//(?:www\.)?([^/:?#]+)", 1))
    host = F.coalesce(F.when(host != "", host), df[source].cast("string"), F.lit(""))
    rows = df.where(df[html].isNotNull() & df[id].isNotNull()).select(
        F.xxhash64(df[id], df[html], df[body]).alias("row"), host.alias("host"), df[id].cast("string").alias("id"), df[html].alias("html"), df[body].alias("body")
    )
    return rows.mapInArrow(_parse, _PAGE)


def contents(pages: DataFrame) -> DataFrame:
    """(host, by_headline, by_lead, n): whether headlines and longest paragraphs tell the host's contents apart, and
    how many contents it has.

    A headline or paragraph that the site puts on all its pages tells none apart: a mark counts where it takes
    half as many values as both marks together.
    """
    marks = _marked(pages.select("host", "id", "headline", "lead")).groupBy("host", "headline", "lead").agg(F.lit(1).alias("x"))
    both = marks.groupBy("host").agg(F.count("*").alias("n"))
    for mark in ("headline", "lead"):
        values = marks.groupBy("host", mark).agg(F.lit(1).alias("x")).groupBy("host").agg(F.count("*").alias(f"n_{mark}"))
        both = both.join(values, "host")
    told = [(F.col(f"n_{m}") * 2 >= F.col("n")).alias(f"by_{m}") for m in ("headline", "lead")]
    least = F.least("n", *[F.when(F.col(f"n_{m}") * 2 >= F.col("n"), F.col(f"n_{m}")) for m in ("headline", "lead")])
    return both.select("host", *told, least.alias("n"))


def _marked(pages: DataFrame) -> DataFrame:
    """``pages`` with a page's id as its mark where it has no headline or paragraph."""
    own = lambda c: F.when(F.col(c) == 0, F.xxhash64("id")).otherwise(F.col(c)).alias(c)
    return pages.select(*[own(c) if c in ("headline", "lead") else c for c in pages.columns])


def recurring(one: DataFrame, pages: DataFrame, recurs: int, share: float) -> DataFrame:
    """(host, shape, n_contents) of the shapes in ``one`` (host, id, headline, lead, shape) that stand in at least ``recurs``
    contents of a host and in ``share`` of them.

    Contents are counted by headline and by longest paragraph, and the lesser count holds, so that neither copies of
    an article nor its re-edited versions count as several; all aggregations combine before they shuffle.
    """
    once = _marked(one).groupBy("host", "shape", "headline", "lead").agg(F.lit(1).alias("x"))
    # No subtree stands in more contents than in pairs of marks; only the few at the minimum are counted by each mark.
    found = checkpointed(once.groupBy("host", "shape").agg(F.count("*").alias("n_contents")).where(F.col("n_contents") >= recurs))
    some = once.join(found.select("host", "shape"), ["host", "shape"], "left_semi").drop("x")
    for mark in ("headline", "lead"):
        values = some.groupBy("host", "shape", mark).agg(F.lit(1).alias("x"))
        found = found.join(values.groupBy("host", "shape").agg(F.count("*").alias(f"n_{mark}")), ["host", "shape"])
    found = found.join(contents(pages), "host")
    least = F.least("n_contents", *[F.when(F.col(f"by_{m}"), F.col(f"n_{m}")) for m in ("headline", "lead")])
    return found.select("host", "shape", least.alias("n_contents"), "n").where((F.col("n_contents") >= recurs) & (F.col("n_contents") >= share * F.col("n"))).drop("n")


def templates(pages: DataFrame, recurs: int = RECURS, share: float = RECURS_SHARE) -> DataFrame:
    """(host, shape, n_contents) of the subtrees that recur on a host."""
    shapes = F.explode(F.array_distinct(F.concat("runs", "subtrees"))).alias("shape")
    return recurring(pages.select("host", "id", "headline", "lead", shapes).where("shape <> 0"), pages, recurs, share)


def with_template(pages: DataFrame, recurs: int = RECURS) -> DataFrame:
    """``pages`` with ``template``: the shapes on the page that recur on its host."""
    pairs = pages.select("host", "row", F.explode(F.array_distinct(F.concat("runs", "subtrees"))).alias("shape")).where("shape <> 0")
    hit = pairs.join(templates(pages, recurs).drop("n_contents"), ["host", "shape"], "left_semi")
    sets = hit.groupBy("row").agg(F.collect_set("shape").alias("template"))  # no more than the page has
    return pages.join(sets, "row", "left")


def judged(df: DataFrame, recurs: int = RECURS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(pages with the verdict on each block, (host, place) of the places at which template recurs)."""
    pages = checkpointed(parsed_pages(df, **columns).dropDuplicates(["row"]))
    found = checkpointed(with_template(pages, recurs).mapInArrow(_judge, _VERDICT))
    seen = found.select("host", "id", "headline", "lead", F.explode("evidence").alias("shape"))
    places = recurring(seen, found, recurs, RECURS_SHARE).select("host", F.col("shape").alias("place"))
    return found, places


def outside_lines(df: DataFrame, recurs: int = RECURS, **columns: str) -> DataFrame:
    """(id, line_no): the lines of ``body`` that stand on the page outside the article."""
    found, places = judged(df, recurs, **columns)
    late = found.select("host", "id", F.inline(F.arrays_zip("open_lines", "open_places")).alias("line_no", "place"))
    late = late.join(places, ["host", "place"], "left_semi").select("id", "line_no")
    return found.select("id", F.explode("lines").alias("line_no")).unionByName(late).distinct()


def main_text(df: DataFrame, recurs: int = RECURS, **columns: str) -> DataFrame:
    """(id, main_text): the article's own text of each page, from its html alone, paragraphs apart by a blank line."""
    html, id, body = columns.get("html", "html"), columns.get("id", "id"), columns.get("body", "body")
    found, places = judged(df, recurs, **columns)
    each = found.select("host", "row", F.explode(F.array_distinct("places")).alias("place")).where("place <> 0")
    sets = each.join(places, ["host", "place"], "left_semi").groupBy("row").agg(F.collect_set("place").alias("template"))
    known = found.select("row", "verdict", "places").join(sets, "row", "left")
    rows = df.where(df[html].isNotNull() & df[id].isNotNull()).select(
        F.xxhash64(df[id], df[html], df[body]).alias("row"), df[id].cast("string").alias("id"), df[html].alias("html")
    )
    return rows.join(known, "row").select("id", "html", "verdict", "places", "template").mapInArrow(_texts, "id string, main_text string")
