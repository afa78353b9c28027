from datetime import date, timedelta

from pyspark.sql import functions as F

from fathomline.operators import launches as L
from fathomline.operators import series as S
from fathomline.operators.intervals import first_interval, join_intervals

D0 = date(2024, 1, 1)


def _points(spark, gains, sid="a", start=D0):
    return S.cumulative_points(spark.createDataFrame([(sid, start + timedelta(days=i), g) for i, g in enumerate(gains)], "series_id string, day date, gain int"))


def _day(n):
    return D0 + timedelta(days=n)


def test_spike_is_one_episode(spark):
    daily = S.fill_daily(_points(spark, [3] * 60 + [200, 150, 40] + [3] * 60), F.lit("2024-06-01").cast("date"))
    (e,) = S.growth_episodes(daily).collect()
    assert e["start_day"] == _day(60) and e["delta"] >= 350 and e["peak_day"] == _day(60) and e["peak_value"] == 200 and e["baseline_per_day"] == 3.0


def test_steady_growth_has_no_episode(spark):
    assert S.growth_episodes(S.fill_daily(_points(spark, [5] * 200), F.lit("2024-06-01").cast("date"))).count() == 0


def test_short_and_empty_series(spark):
    assert S.growth_episodes(_points(spark, [500, 500])).count() == 0
    assert S.growth_episodes(_points(spark, [])).count() == 0


def test_fill_and_value_at(spark):
    p = spark.createDataFrame([("a", date(2024, 1, 1), 1), ("a", date(2024, 1, 4), 5)], "series_id string, day date, cum bigint")
    filled = S.fill_daily(p, F.lit("2024-01-05").cast("date")).orderBy("day").collect()
    assert [r["cum"] for r in filled] == [1, 1, 1, 5, 5]
    asks = spark.createDataFrame([("a", date(2023, 12, 1)), ("a", date(2024, 1, 3)), ("a", date(2024, 1, 4)), ("a", date(2025, 1, 1)), ("b", date(2024, 1, 1))], "series_id string, day date")
    got = {(r["series_id"], str(r["day"])): r["value"] for r in S.value_at(p, asks).collect()}
    assert got == {("a", "2023-12-01"): 0, ("a", "2024-01-03"): 1, ("a", "2024-01-04"): 5, ("a", "2025-01-01"): 5, ("b", "2024-01-01"): None}
    inter = {str(r["day"]): r["value"] for r in S.value_at(p, asks, interpolate=True).where("series_id = 'a'").collect()}
    assert inter == {"2023-12-01": None, "2024-01-03": 4, "2024-01-04": 5, "2025-01-01": 5}


def test_snapshots_keep_the_last(spark):
    daily = S.fill_daily(_points(spark, [1] * 2000), F.lit(_day(1999).isoformat()).cast("date"))
    s = S.snapshots(daily)
    assert s.count() < 400 and s.agg(F.max("day")).first()[0] == _day(1999)


def test_clusters_and_windows(spark):
    rows = [("t", "r1", "release", _day(0)), ("t", "h1", "post", _day(1)), ("t", "s1", "show", _day(30)), ("t", "r2", "release", _day(31)), (None, "x", "show", _day(3)), ("t", "y", "show", None)]
    ev = spark.createDataFrame(rows, "series_id string, event_id string, kind string, day date")
    (c,) = L.cluster_launches(ev, F.col("kind") == "show").collect()
    assert (c["anchor"], c["end_day"], c["n_events"], c["prior_launches"]) == (_day(30), _day(31), 2, 0)
    assert L.cluster_launches(ev, (F.col("kind") == "show") | (F.col("event_id") == "h1")).count() == 2
    assert {r["event_id"] for r in L.launch_members(ev, F.col("kind") == "show").collect()} == {"s1", "r2"}
    p = _points(spark, [10] * 60, sid="t")
    w = L.outcome_windows(L.cluster_launches(ev, F.col("kind") == "show"), p, F.lit(_day(34).isoformat()).cast("date"))
    assert {r["label"]: r["value"] for r in w.collect()} == {"before": 300, "+24h": 320, "+48h": 330}


def test_interval_joins(spark):
    left = spark.createDataFrame([("k", 1, _day(0), _day(100)), ("k", 2, _day(50), _day(50)), ("z", 3, _day(0), _day(1)), ("k", 4, None, None)], "k string, l_id int, l_start date, l_end date")
    right = spark.createDataFrame([("k", "a", _day(40), _day(60)), ("k", "b", _day(50), _day(49)), ("k", "c", _day(10), _day(90))], "k string, r string, r_start date, r_end date")
    for width in (1, 7, 365):
        got = sorted((r["l_id"], r["r"]) for r in join_intervals(left, right, ["k"], width).collect())
        assert got == [(1, "a"), (1, "c"), (2, "a"), (2, "c")]
    assert sorted((r["l_id"], r["r"]) for r in first_interval(left, right, ["k"], ["r_start"]).collect()) == [(2, "c")]
