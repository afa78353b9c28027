from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from fathomline.operators import series as S
from fathomline.streaming import growth as G


def _run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _files(df, path, parts):
    """One file for each part, in order, so that the watermark advances between batches."""
    for i, p in enumerate(parts):
        df.where(p).coalesce(1).write.parquet(f"{path}/{i}")


def test_spikes_equal_batch(spark, tmp_path):
    gains = [3] * 20 + [0, 0, 90, 40] + [2] * 10
    rows = [("a", date(2024, 1, 1) + timedelta(days=i), g) for i, g in enumerate(gains) if g]
    df = spark.createDataFrame(rows, "series_id string, day date, gain bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = _run(spark, G.totals_and_spikes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "spikes")
    daily = S.fill_daily(S.cumulative_points(df), F.lit("2024-02-03").cast("date"))
    want = {(r["day"], r["cum"], r["spike"]) for r in S.spikes(daily).where("gain > 0").collect()}
    assert {(r["day"], r["cum"], r["spike"]) for r in got.collect()} == want


def test_a_late_day_counts_for_the_total_only(spark, tmp_path):
    day = date(2024, 1, 1)
    rows = [("a", day + timedelta(days=i), g) for i, g in ((0, 3), (5, 4), (2, 90))]
    df = spark.createDataFrame(rows, "series_id string, day date, gain bigint")
    for k, r in enumerate(rows):
        df.where(F.col("day") == r[1]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {(r["day"], r["cum"], r["spike"]) for r in _run(spark, G.totals_and_spikes(source), "late").collect()}
    assert max(c for _, c, _ in got) == 97 and (day + timedelta(days=2), 97, False) in got


def test_sessions_and_days(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0, True, 1), ("a", t0 + timedelta(days=2), False, 2), ("a", t0 + timedelta(days=12), False, 4), ("a", t0 + timedelta(days=40), True, 8), ("a", t0 + timedelta(days=80), True, 16)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, strong boolean, gain int")
    _files(df, str(tmp_path / "in"), ["gain <= 2", "gain = 4", "gain = 8", "gain = 16"])
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sessions = {(r["anchor"], r["n_events"]) for r in _run(spark, G.launch_sessions(source), "sessions").collect()}
    assert (t0, 2) in sessions and sessions <= {(t0, 2), (t0 + timedelta(days=40), 1)}
    days = {(r["day"], r["gain"]) for r in _run(spark, G.daily_gains(source), "days").collect()}
    assert {(date(2024, 1, 1), 1), (date(2024, 1, 3), 2), (date(2024, 1, 13), 4)} <= days
