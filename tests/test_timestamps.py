import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.operators.timestamps import local_to_utc_us, normalise_timestamps

ZONES = [("ny", "America/New_York", "mdy"), ("ny", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("jp", "Asia/Tokyo", "ymd")]


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("ny", "2024-09-27T02:32:38Z", us(2024, 9, 27, 2, 32, 38)),
    ("ny", "2024-09-27 02:32:38.5", us(2024, 9, 27, 6, 32, 38) + 500_000),
    ("de", "20230508T112843Z", us(2023, 5, 8, 11, 28, 43)),
    ("ny", "1685065883", 1685065883 * 1_000_000),
    ("ny", "1667611839898", 1667611839898 * 1000),
    ("ny", "11/06/2023 00:09", us(2023, 11, 6, 5, 9)),
    ("de", "11/06/2023 00:09", us(2023, 6, 10, 22, 9)),
    ("jp", "2024.07.07 05:49", us(2024, 7, 6, 20, 49)),
    ("ny", "Published: Friday, Jun 23 2023 5:50 AM local ", us(2023, 6, 23, 9, 50)),
    ("ny", "December 11, 2024 at 4:49 p.m. ET", us(2024, 12, 11, 21, 49)),
    ("ny", "Sat, 08 Jul 2023 07:11:06 GMT", us(2023, 7, 8, 7, 11, 6)),
    ("ny", "30 May 2022, 14:16 UTC+02:00", us(2022, 5, 30, 12, 16)),
    ("ny", "2023-03-18T14:19:42-04:00", us(2023, 3, 18, 18, 19, 42)),
    ("de", "3. Oktober 2023 12:00", us(2023, 10, 3, 10)),
    ("ny", "2023-11-05 01:30:00", us(2023, 11, 5, 5, 30)),  # occurs twice: the first
    ("ny", "2023-11-05 01:30 EST", us(2023, 11, 5, 6, 30)),  # says which
    ("ny", "2023-03-12 02:30:00", us(2023, 3, 12, 7, 30)),  # never occurs: offset before the change
    ("ny", "12:30 AM", None), ("ny", "March 2023", None), ("ny", "2023-04-20", None), ("ny", "yesterday", None),
    ("ny", "2023-02-30 10:00:00", None), ("ny", "2023-02-20 25:00:00", None), ("ny", "", None), ("ny", None, None),
    ("nowhere", "2023-04-20 10:00", None), (None, "2023-04-20T10:00:00+01:00", us(2023, 4, 20, 9)),
]


def test_notations(spark):
    rows = [(i, s, p, s) for i, (s, p, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, source string, published string, __zone string")
    zones = spark.createDataFrame(ZONES, "source string, home_tz string, date_order string")
    out = normalise_timestamps(df, zones)
    assert out.columns == ["id", "source", "published", "__zone", "utc_us", "utc_pattern"]
    got = {r["id"]: r["utc_us"] for r in out.where("utc_us is null or utc_us is not null").collect()}
    assert len(got) == len(CASES)
    for i, (s, p, want) in enumerate(CASES):
        assert got[i] == want, (s, p)


def test_empty_table(spark):
    df = spark.createDataFrame([], "source string, published string")
    zones = spark.createDataFrame([], "source string, home_tz string, date_order string")
    assert normalise_timestamps(df, zones).count() == 0


@pytest.mark.parametrize(
    "local,ambiguous,nonexistent,want",
    [
        ((2023, 11, 5, 1, 30), "second", "before", us(2023, 11, 5, 6, 30)),
        ((2023, 11, 5, 1, 30), "null", "before", None),
        ((2023, 3, 12, 2, 30), "first", "after", us(2023, 3, 12, 6, 30)),
        ((2023, 3, 12, 2, 30), "first", "null", None),
        ((2023, 7, 1, 12, 0), "null", "null", us(2023, 7, 1, 16)),
    ],
)
def test_policies(spark, local, ambiguous, nonexistent, want):
    c = local_to_utc_us(F.lit(us(*local)), F.lit("America/New_York"), ambiguous, nonexistent)
    assert spark.range(1).select(c.alias("x")).first()["x"] == want
