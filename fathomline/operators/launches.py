"""Launch clusters and the outcome windows after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.operators.series import value_at

# Labels and days of the windows after a launch.
WINDOWS = (("+24h", 1), ("+48h", 2), ("+7d", 7), ("+30d", 30), ("+90d", 90))


def _sessions(events: DataFrame, strong: Column, gap_days: int) -> DataFrame:
    """(series_id, day, session, n, strong): events are counted per day first, so a busy series is bounded by its calendar."""
    days = (
        events.where("series_id IS NOT NULL AND day IS NOT NULL").groupBy("series_id", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(strong), F.lit(False)).alias("strong"))
    )
    by_day = Window.partitionBy("series_id").orderBy("day")
    opens = F.when(F.datediff("day", F.lag("day").over(by_day)) <= gap_days, 0).otherwise(1)
    return days.withColumn("opens", opens).withColumn("session", F.sum("opens").over(by_day.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def cluster_launches(events: DataFrame, strong: Column, gap_days: int = 4) -> DataFrame:
    """Sessions of ``events (series_id, day, ...)`` at most ``gap_days`` apart that hold a strong event.

    Gives ``series_id, cluster, anchor, end_day, n_events, prior_launches``. The gap is measured from the member before.
    Events without a series or a day belong to no cluster.
    """
    c = _sessions(events, strong, gap_days).groupBy("series_id", "session").agg(
        F.min("day").alias("anchor"), F.max("day").alias("end_day"), F.sum("n").alias("n_events"), F.bool_or("strong").alias("strong")
    )
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("anchor"))
    return c.where("strong").select("series_id", number.alias("cluster"), "anchor", "end_day", "n_events", (number - 1).alias("prior_launches"))


def launch_members(events: DataFrame, strong: Column, gap_days: int = 4) -> DataFrame:
    """``series_id, anchor, event_id`` of every event in a launch cluster, one row each rather than one list per cluster."""
    s = _sessions(events, strong, gap_days)
    c = s.groupBy("series_id", "session").agg(F.min("day").alias("anchor"), F.bool_or("strong").alias("launch")).where("launch")
    days = s.select("series_id", "day", "session").join(c, ["series_id", "session"]).select("series_id", "day", "anchor")
    return events.select("series_id", "day", "event_id").join(days, ["series_id", "day"]).select("series_id", "anchor", "event_id")


def outcome_windows(clusters: DataFrame, points: DataFrame, today: Column) -> DataFrame:
    """The total the day before each cluster's anchor and at the end of each window that is not after ``today``."""
    offsets = F.array(F.struct(F.lit("before").alias("label"), F.lit(-1).alias("offset")), *[F.struct(F.lit(n).alias("label"), F.lit(d).alias("offset")) for n, d in WINDOWS])
    asks = clusters.select("series_id", "anchor", F.inline(offsets)).select("series_id", "anchor", "label", F.expr("date_add(anchor, offset)").alias("day"))
    asks = asks.where((F.col("label") == "before") | (F.col("day") <= today))
    return value_at(points, asks).select("series_id", "anchor", "label", "day", "value")


def compare_launches(windows: DataFrame) -> DataFrame:
    """One row per launch: the gain over the day before at each window, null where it is missing."""
    wide = windows.groupBy("series_id", "anchor").pivot("label", ["before", *[n for n, _ in WINDOWS]]).agg(F.first("value"))
    return wide.select("series_id", "anchor", F.col("before").alias("before_value"), *[(F.col(f"`{n}`") - F.col("before")).alias("gain_" + n.strip("+")) for n, _ in WINDOWS])


def summarize_launches(windows: DataFrame) -> DataFrame:
    """One text per launch: the gains of its known windows in order, if the day before and one more are known."""
    base = windows.where("label = 'before' AND value IS NOT NULL").select("series_id", "anchor", F.col("value").alias("base"))
    later = windows.where("label <> 'before' AND value IS NOT NULL").join(base, ["series_id", "anchor"])
    text = F.concat(F.col("label"), F.lit(": "), (F.col("value") - F.col("base")).cast("string"))
    parts = later.groupBy("series_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("day", text.alias("text")))).alias("p"))
    return parts.select("series_id", "anchor", F.array_join(F.transform("p", lambda x: x["text"]), "; ").alias("summary"))
