"""Timestamps in mixed notations and zones, normalised to one UTC instant.

An ordered cascade of anchored patterns is tried on the text; the first whose parts make a real
date with a time of day decides. Text without a zone is local to a default zone that is looked up
by source. Everything is built-in column arithmetic, so the operator is one projection on the scan.

Cases: null, blank or unusable text gives null ``utc_us``; a date without a time of day, a time
without a date, and relative text ("yesterday") denote no instant and give null; an unknown source
has no default zone, so only text with an offset gives an instant; duplicate lookup rows for a source
count once; repeated rows stay; clashing names of extra columns are kept apart from the work columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.stage import staged

# Month names by language, first letters suffice where they are unique.
MONTHS = {
    1: "january jan januar janvier janv enero ene janeiro gennaio gen januari jän",
    2: "february feb februar février fevrier févr fevr febrero fevereiro fev febbraio februari",
    3: "march mar märz maerz mrz mars marzo março marco maart mrt",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maio maggio mag mei",
    6: "june jun juni juin junio junho giugno giu",
    7: "july jul juli juillet juil julio julho luglio lug",
    8: "august aug août aout agosto ago augustus",
    9: "september sep sept septembre septiembre setembro set settembre",
    10: "october oct oktober okt octobre octubre outubro out ottobre ott",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre decembre déc diciembre dic dezembro dicembre",
}
# Abbreviations that name standard time; in an hour that occurs twice they mean the second.
STANDARD = "EST CST MST PST AKST GMT WET CET EET AEST ACST NZST"

_MON = r"(\p{L}{3,12})\.?"
_WEEKDAY = r"(?:\p{L}{2,12}(?:-feira)?\.?,? +)?"
_TIME = r"(\d{1,2})(?:[:.h](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?)? ?([ap]\.? ?m\b\.?)?"
_ZONE = r" ?(?:\(?(Z|(?:UTC|GMT)? ?[+-]\d{1,2}(?::?\d{2})?|\p{L}{2,5}(?: time)?|local time|\p{L}+/[\p{L}_/]+)\)?)?"
_SEP = r"(?:,? +(?:at|um|à|alle|om|às|as|a las|- |– )? ?|T|, ?)"
_DAY = r"(\d{1,2})(?:st|nd|rd|th|\.|º)?"

# (name, pattern, order of the groups). Groups: y M d = year, month, day; a b c = the three numbers of an
# all-numeric date in the source's order; N = month name; h m s f p = time; z = zone.
CASCADE: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:T|,? +){_TIME}{_ZONE}$", "yMdhmsfpz"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?()?{_ZONE}$", "yMdhmsfpz"),
    ("year first", rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_SEP}{_TIME}{_ZONE}$", "yMdhmsfpz"),
    ("numeric", rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}}){_SEP}{_TIME}{_ZONE}$", "abchmsfpz"),
    ("day month", rf"^{_WEEKDAY}{_DAY}(?: de)?[ -]{_MON},?(?: de)?[ -](\d{{4}}){_SEP}{_TIME}{_ZONE}$", "dNyhmsfpz"),
    ("month day", rf"^{_WEEKDAY}{_MON} {_DAY},? (\d{{4}}){_SEP}{_TIME}{_ZONE}$", "Ndyhmsfpz"),
    ("asctime", rf"^{_WEEKDAY}{_MON} {_DAY} {_TIME}{_ZONE} (\d{{4}})$", "Ndhmsfpzy"),
    ("time first", rf"^{_TIME}{_ZONE},?(?: on)? {_WEEKDAY}{_DAY} {_MON},? (\d{{4}})$", "hmsfpzdNy"),
    ("time first, month day", rf"^{_TIME}{_ZONE},?(?: on)? {_WEEKDAY}{_MON} {_DAY},? (\d{{4}})$", "hmsfpzNdy"),
]
_EPOCH = r"^(?:\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.\d+)?$"


SLOTS = "yMdabcNhmsfpz"
NUMBERS = {"y": "y", "M": "mon", "d": "d", "a": "a", "b": "b", "c": "c", "h": "h", "m": "min", "s": "s"}


#: Years of two digits from here on are of the last century.
PIVOT = 70


def _months() -> Column:
    return F.create_map(*[x for n, names in MONTHS.items() for w in names.split() for x in (F.lit(w), F.lit(n))])


def _canonical(text: Column) -> Column:
    """Name of the first pattern that matches and its groups in the order of SLOTS, joined by U+0001."""
    tries = []
    for name, pattern, order in CASCADE:
        groups = "\u0001".join(f"${order.index(k) + 1}" if k in order else "" for k in SLOTS)
        tries.append(
            F.when(text.rlike("(?i)" + pattern), F.regexp_replace(text, "(?i)" + pattern, f"{name}\u0001{groups}"))
        )
    return F.coalesce(*tries)


def local_to_utc_us(local_us: Column, zone: Column, ambiguous: str = "first", nonexistent: str = "before") -> Column:
    """UTC microseconds of local microseconds in ``zone`` (an IANA name).

    ``ambiguous``: ``first`` or ``second`` occurrence, or ``null``. ``nonexistent``: read with the offset in
    force ``before`` or ``after`` the change, or ``null``. An unknown zone gives null.
    """
    known = zone.rlike(r"^[A-Za-z]+(/[A-Za-z_+0-9-]+)*$")
    local = F.timestamp_micros(local_us)
    first = F.unix_micros(F.to_utc_timestamp(local, F.when(known, zone)))
    back = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(first), F.when(known, zone)))
    out = first
    if nonexistent != "before":
        # In a gap, the reading with the offset before lands after the change by what the local time jumped.
        out = F.when(back != local_us, F.lit(None) if nonexistent == "null" else first - (back - local_us)).otherwise(out)
    if ambiguous != "first":
        later = F.lit(None).cast("long")
        for minutes in (120, 60, 30):
            t = first + minutes * 60_000_000
            again = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), F.when(known, zone))) == local_us
            later = F.coalesce(F.when(again, t), later)
        out = F.when(later.isNotNull(), F.lit(None) if ambiguous == "null" else later).otherwise(out)
    return out


def normalise_timestamps(
    df: DataFrame,
    sources: DataFrame,
    text: str = "published",
    source: str = "source",
    out: str = "utc_us",
    pattern: str = "utc_pattern",
    ambiguous: str = "first",
    nonexistent: str = "before",
) -> DataFrame:
    """``df`` with ``out`` (BIGINT, UTC microseconds) and ``pattern`` (which notation it was).

    ``sources`` has source, home_tz and date_order. It is joined by Spark's own choice, so it is
    broadcast only while its measured size allows.
    """
    look = (
        sources.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.min(F.struct("home_tz", "date_order")).alias("zone"))
        .select(F.col("source").alias("__source"), "zone")
    )
    kept = [c for c in df.columns if c not in (out, pattern)]
    held = [f"__{i}" for i in range(len(kept))]  # whatever the columns are called
    columns = [df[f"`{c}`"].alias(h) for c, h in zip(kept, held)]
    work = df.select(*columns, df[source].alias("source"), df[text].alias("text"))
    work = work.join(look, F.col("source") == F.col("__source"), "left").select(
        *held, F.col("zone")["home_tz"].alias("home"), F.col("zone")["date_order"].alias("order"), "text"
    )

    t = F.regexp_replace(F.col("text"), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"^ | $", "")
    t = F.regexp_replace(t, r"(?i)^\p{L}[\p{L} ]*+: ?", "")
    t = F.regexp_replace(t, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)(?:day|sday|nesday|rsday|urday|s|r|rs)?\.?,? ", "")
    work = staged(work.withColumn("text", t), [*held, "home", "order"], {"text": F.col("text")})
    work = staged(work, [*held, "home", "order", "text"], {"got": F.split(_canonical(F.col("text")), "\u0001")})
    part = {k: F.col("got")[i + 1] for i, k in enumerate(SLOTS)}
    work = work.select(
        *held, "home", "order", "text", F.col("got")[0].alias("name"), F.upper(F.trim(part["z"])).alias("zone"),
        F.trim(part["z"]).alias("zone_text"), F.lower(F.substring(F.ltrim(part["p"]), 1, 1)).alias("half"),
        F.rpad(part["f"], 6, "0").substr(1, 6).alias("f"), F.length(part["c"]).alias("c_size"),
        F.try_element_at(_months(), F.lower(part["N"])).alias("named"), *[part[k].try_cast("int").alias(NUMBERS[k]) for k in NUMBERS],
    )
    c = F.col
    century = lambda y: y + F.when(y < PIVOT, 2000).otherwise(1900)
    numeric, ymd = c("name") == "numeric", (c("order") == "ymd") & (c("c_size") == 2)
    work = work.select(
        *held, "home", "text", "name", "zone", "zone_text",
        F.when(~numeric, c("y")).when(ymd, century(c("a"))).when(c("c_size") == 2, century(c("c"))).otherwise(c("c")).alias("year"),
        F.when(~numeric, F.coalesce("named", "mon")).when(c("order") == "mdy", c("a")).otherwise(c("b")).alias("month"),
        F.when(~numeric, c("d")).when(c("order") == "mdy", c("b")).when(ymd, c("c")).otherwise(c("a")).alias("day"),
        (~numeric | c("order").isNotNull()).alias("known"),
        F.when(c("half") == "", F.when(c("h") <= 23, c("h")))
        .when(c("h").between(1, 12), c("h") % 12 + F.when(c("half") == "p", 12).otherwise(0)).alias("hour"),
        F.coalesce("min", F.when(c("half") != "", F.lit(0))).alias("minute"),
        F.coalesce("s", F.lit(0)).alias("second"), F.when(c("f") == "000000", 0).otherwise(F.coalesce(c("f").try_cast("long"), F.lit(0))).alias("micros"),
    )
    good = c("known") & c("year").between(1000, 9999) & c("month").between(1, 12) & c("day").between(1, 31)
    good = good & c("hour").isNotNull() & c("minute").between(0, 59) & c("second").between(0, 59)
    text_date = F.when(good, F.format_string("%04d-%02d-%02d", "year", "month", "day"))
    days = F.unix_date(F.try_to_date(text_date, "yyyy-MM-dd")).cast("long")
    seconds = (c("hour").cast("long") * 60 + c("minute")) * 60 + c("second")
    local = days * 86_400_000_000 + seconds * 1_000_000 + c("micros")
    work = staged(work, [*held, "home", "text", "name", "zone", "zone_text"], {"local": local})

    numeral = F.regexp_extract(c("text"), r"^(\d+)", 1)
    scale = F.when(F.length(numeral) <= 10, 1_000_000).when(F.length(numeral) == 13, 1_000).otherwise(1)
    fraction = F.coalesce(F.regexp_extract(c("text"), r"(\.\d+)$", 1).try_cast("double"), F.lit(0.0))
    epoch = F.when(
        c("text").rlike(_EPOCH),
        F.when(F.length(numeral) == 19, F.substring(numeral, 1, 16).try_cast("long")).otherwise(
            numeral.try_cast("long") * scale + F.floor(fraction * scale)
        ),
    )
    sign = F.when(F.regexp_extract(c("zone"), r"([+-])", 1) == "-", -1).otherwise(1)
    off_h = F.regexp_extract(c("zone"), r"[+-](\d{1,2})", 1).try_cast("int")
    off_m = F.coalesce(F.regexp_extract(c("zone"), r"[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    offset = F.when((off_h <= 18) & (off_m <= 59), c("local") - sign * (off_h * 60 + off_m).cast("long") * 60_000_000)
    named = F.when(c("zone_text").contains("/"), c("zone_text")).otherwise(c("home"))
    us = (
        F.when(c("zone").isin("Z", "UTC", "UT", "GMT"), c("local"))
        .when(c("zone").rlike("[+-]"), offset)
        .when(c("zone").isin(*STANDARD.split()), local_to_utc_us(c("local"), named, "second", nonexistent))
        .otherwise(local_to_utc_us(c("local"), named, ambiguous, nonexistent))
    )
    name = F.when(c("text").rlike(_EPOCH), F.lit("epoch")).otherwise(c("name"))
    work = staged(work, held, {"name": name, "us": F.coalesce(epoch, us)})
    return work.select(
        *[c(h).alias(k) for k, h in zip(kept, held)], c("us").alias(out), F.when(c("us").isNotNull(), c("name")).alias(pattern)
    )
