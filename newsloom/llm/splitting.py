"""Long texts cut into pieces of bounded size at natural boundaries, with overlap.

One regular expression with bounded quantifiers cuts the whole text. Its alternatives are ordered by the
strength of the boundary they end at: a line end, else a sentence end (. ! ? or a closing quote before white
space), else a word end, else a character; each takes as many words as fit. An alternative first
tries to leave room for the overlap and, where only a longer stretch ends at that boundary, fills the limit. The
limit is in words; where ``characters`` sets one in characters too, a longer piece is cut again, behind the last white
space before it or, within a longer word, at the character.
Each piece then takes back up to ``overlap`` words from the end of the piece before, by array functions on
its last words, as far as the limit allows. All of it is SQL functions on the JVM; texts are never cut short.

A boundary is weaker than a line only where a line is longer than the limit, and weaker than a sentence only
where a sentence is: pieces start at line starts, or within an overlong line, at sentence starts.

Cases: null gives no pieces; empty and blank text gives one piece, the text itself; text within the limit
is one piece; text without white space is one word and so one piece, unless ``characters`` is set; repeated rows are cut alike; extra
columns are kept and may have any names but those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.stage import staged

# White space in the Unicode sense, and the separators that count as such elsewhere.
SPACE, BLANK, WORD = r"[\s\x1c-\x1f]", r"[\s\x1c-\x1f&&[^\n]]", r"[^\s\x1c-\x1f]"
CLOSING = "\"'”’»“›"


def piece_pattern(limit: int, fresh: int) -> str:
    """Pattern whose matches are the pieces of a text, white space after a piece included.

    ``fresh`` is the number of words that leaves room for the overlap, ``limit`` the most. The last
    alternative meets the white space before the first word, however much there is.
    """
    some = rf"(?:{WORD}++{SPACE}++)"

    def ending(end: str, n: int) -> str:
        return rf"{some}{{0,{n - 1}}}{end}"

    line = rf"{WORD}++{BLANK}*+(?:\n{SPACE}*+|\z)"
    sentence = rf"{WORD}*[.!?{CLOSING}](?={SPACE}|\z){SPACE}*+"
    word = rf"{WORD}++{SPACE}*+"
    kinds = [ending(end, n) for end in (line, sentence) for n in (fresh, limit)]
    return "(?U)" + "|".join([*kinds, ending(word, fresh), rf"{SPACE}++"])


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U){WORD}+"))


def split_text(df: DataFrame, text: str, limit: int = 512, overlap: int = 64, characters: int | None = None) -> DataFrame:
    """``df`` with n_words and pieces: an array of (piece_no, cut, n_words, n_overlap, text).

    ``cut`` says where the piece ends: ``line``, ``sentence``, ``word``, ``character``, or ``end`` at the end of the text.
    """
    names = list(df.columns)
    held = [f"__{i}" for i in range(len(names))]  # whatever the columns are called
    rows = df.select(*[df[f"`{c}`"].alias(h) for c, h in zip(names, held)], df[text].alias("text"))
    rows = staged(rows, [*held, "text"], {"n": n_words(F.col("text"))})
    long = F.col("n") > limit
    raw = F.when(long, F.regexp_extract_all("text", F.lit(piece_pattern(limit, limit - overlap)), F.lit(0))).otherwise(
        F.array("text")
    )
    rows = staged(rows, [*held, "text", "n"], {"raw": F.when(F.col("text").isNotNull(), raw)})
    lead = rf"(?U)^{SPACE}+\z"
    # White space before the first word belongs to the first piece.
    first = (F.size("raw") > 1) & F.col("raw")[0].rlike(lead)
    merged = F.concat(F.array(F.concat(F.col("raw")[0], F.col("raw")[1])), F.slice("raw", 3, F.size("raw")))
    rows = staged(rows, [*held, "n"], {"raw": F.when(first, merged).otherwise(F.col("raw"))})
    if characters:
        again = rf"(?U)[\s\S]{{1,{characters - 1}}}(?<={WORD}){SPACE}|[\s\S]{{1,{characters}}}"
        cut_again = F.flatten(F.transform("raw", lambda p: F.when(F.length(p) > characters, F.regexp_extract_all(p, F.lit(again), F.lit(0))).otherwise(F.array(p))))
        rows = staged(rows, [*held, "n"], {"raw": cut_again})
    # Words of each piece with the white space after them; lookback reads them from its end.
    words = F.transform("raw", lambda p: F.regexp_extract_all(p, F.lit(rf"(?U){WORD}+{SPACE}*"), F.lit(0)))
    rows = staged(rows, [*held, "n", "raw"], {"words": words})

    def piece(p: Column, i: Column) -> Column:
        mine = F.size(F.col("words")[i])
        before = F.col("words")[i - 1]
        back = F.when(i > 0, F.greatest(F.lit(0), F.least(F.lit(overlap), F.lit(limit) - mine, F.size(before)))).otherwise(0)
        taken = F.when(back > 0, F.array_join(F.slice(before, -back, back), "")).otherwise("")
        cut = (
            F.when(i == F.size("raw") - 1, "end")
            .when(p.rlike(rf"(?U)\n{SPACE}*\z"), "line")
            .when(p.rlike(rf"(?U)[.!?{CLOSING}]{SPACE}+\z"), "sentence")
            .when(p.rlike(rf"(?U){SPACE}\z") | ~F.col("raw")[i + 1].rlike(rf"(?U)^{WORD}"), "word")
            .otherwise("character")
        )
        return F.struct(
            i.alias("piece_no"), cut.alias("cut"), (mine + back).alias("n_words"), back.alias("n_overlap"), F.concat(taken, p).alias("text")
        )

    made = staged(rows, [*held, "n"], {"pieces": F.transform("raw", piece)})
    kept = [F.col(h).alias(c) for c, h in zip(names, held) if c not in ("n_words", "pieces")]
    return made.select(*kept, F.col("n").alias("n_words"), "pieces")


def pieces(df: DataFrame, text: str, limit: int = 512, overlap: int = 64, characters: int | None = None) -> DataFrame:
    """One row per piece: the columns of ``df`` other than ``text``, and piece_no, cut, n_words, n_overlap, text."""
    cut = split_text(df, text, limit, overlap, characters)
    kept = [c for c in df.columns if c not in (text, "piece_no", "cut", "n_words", "n_overlap")]
    return cut.select(*kept, F.inline("pieces"))


def boundary(pieces: Column) -> Column:
    """The weakest boundary among the cuts: line, sentence, or none where a cut is within a sentence."""
    has = lambda kind: F.exists(pieces, lambda p: p["cut"] == kind)
    return F.when(has("word") | has("character"), "none").when(has("sentence"), "sentence").otherwise("line")
