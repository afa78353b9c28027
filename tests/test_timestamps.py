from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fathomline.functions.timestamps import canonical, canonical_epoch
from fathomline.operators import timestamps as O

NOW = datetime(2026, 10, 9, 8, 44, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2021", "2021"), ("2015-08", "2015-08"), ("August 2020", "2020-08"), ("FEBRUARY, 2023", "2023-02"), ("04/2019", "2019-04"),
        ("Q4 2017", "2017-10-01/2017-12-31"), ("2022 Q1", "2022-01-01/2022-03-31"), ("2017-Q2", "2017-04-01/2017-06-30"),
        ("18th June 2021", "2021-06-18"), ("Jul. 13 2018", "2018-07-13"), ("04.03.2021", "2021-03-04"), ("20210619", "2021-06-19"), (" 2023-11-28", "2023-11-28"),
        ("2017-8-13 ", "2017-08-13"), ("2015-09-15T06:50:36.222+0100", "2015-09-15T05:50:36Z"), ("2021-03-24 13:23:29", "2021-03-24T13:23:29Z"),
        ("Mon, 20 May 2019 02:46:59 +1000", "2019-05-19T16:46:59Z"), ("Sat, 08 Aug 2020 17:11:01 MST", "2020-08-09T00:11:01Z"), ("1524705094", "2018-04-26T01:11:34Z"),
        ("1645373750502", "2022-02-20T16:15:50Z"), ("2018-01-05T09:18:31+09:00[Asia/Tokyo]", "2018-01-05T00:18:31Z"), ("2018-04-04 23:54:58 America/New_York", "2018-04-05T03:54:58Z"),
        ("2023-053", "2023-02-22"), ("20190309T135345Z", "2019-03-09T13:53:45Z"), ("10. November 2021, 11:42 Uhr", "2021-11-10T11:42:00Z"),
        ("19 de agosto de 2024, 17:07", "2024-08-19T17:07:00Z"), ("19 juin 2015 à 15h59", "2015-06-19T15:59:00Z"), ("March 18, 2024 at 12:26 AM", "2024-03-18T00:26:00Z"),
        ("3 days ago", "2026-10-06"), ("a week ago", "2026-09-26/2026-10-02"), ("2 weeks ago", "2026-09-19/2026-09-25"), ("One year ago", "2024-10-10/2025-10-09"),
        ("yesterday", None), ("last week", None), ("Feb 30, 2024", None), ("2021-02-30", None), ("0000-00-00", None), ("mid-2019", None), ("n/a", None), ("", None), (None, None), ("x" * 5000, None),
    ],
)
def test_canonical(raw, want):
    assert canonical(raw, ref=NOW) == want


def test_zones_and_clock_changes():
    assert canonical("2021-11-07 01:30:00", "America/New_York") == "2021-11-07T05:30:00Z"  # twice: the first one
    assert canonical("2021-03-14 02:30:00", "America/New_York") == "2021-03-14T07:30:00Z"  # skipped: the offset before
    assert canonical("3/4/2020 1:05 PM", None, month_first=True) == "2020-03-04T13:05:00Z"
    assert canonical("3/4/2020 13:05", "Europe/Berlin") == "2020-04-03T11:05:00Z"
    assert canonical("2 days ago") is None


def test_epochs():
    assert canonical_epoch(1420565173.9) == "2015-01-06T17:26:13Z"
    for x in (1421046859176.0, 1421046859176000.0, 1421046859176000000.0):
        assert canonical_epoch(x) == "2015-01-12T07:14:19Z"
    for x in (None, 0.0, -1.0, float("nan"), float("inf")):
        assert canonical_epoch(x) is None


def _keyed(spark, rows):
    df = spark.createDataFrame(rows, "id int, raw string, t_zone_x string")
    return df.select("id", "t_zone_x", *O.time_key("text", F.col("raw")))


def test_dictionary_is_incremental_and_keeps_rows(spark):
    d = O.TimestampDictionary(spark)
    rows = [(1, "2021", "a"), (2, "2021", "a"), (3, None, "b"), (4, "Q1 2020", None), (4, "Q1 2020", None)]
    out = {(r["id"], r["t_canon"]) for r in O.normalize_times(_keyed(spark, rows), d).collect()}
    assert out == {(1, "2021"), (2, "2021"), (3, None), (4, "2020-01-01/2020-03-31")}
    assert O.normalize_times(_keyed(spark, rows), d).count() == 5
    assert d.read().count() == 2
    O.normalize_times(_keyed(spark, [(9, "May 2020", "a"), (1, "2021", "a")]), d).collect()
    assert sorted(r["t_raw"] for r in d.read().collect()) == ["2021", "May 2020", "Q1 2020"]


def test_hot_texts_are_broadcast_and_equal(spark, monkeypatch):
    rows = [(i, "May 2020" if i % 3 else f"{1900 + i}", None) for i in range(60)]
    want = {(r["id"], r["t_canon"]) for r in O.normalize_times(_keyed(spark, rows)).collect()}
    monkeypatch.setattr(O, "HOT_LEAST", 5)
    got = O.normalize_times(_keyed(spark, rows))
    assert {(r["id"], r["t_canon"]) for r in got.collect()} == want and len(want) == 60


def test_empty_table(spark):
    assert O.normalize_times(_keyed(spark, [])).count() == 0


def test_texts_of_any_length():
    assert canonical("  12 " + " " * 5000 + " May   2020 ") == "2020-05-12"
    assert canonical("x" * 100_000) is None
