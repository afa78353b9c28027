"""Cumulative daily series: totals, calendars, as-of lookup, spikes, growth episodes and what followed them.

A series is ``(series_id, day DATE, cum BIGINT)``. All operators key on ``series_id`` and run for any number of series at
once; one series is bounded by its calendar (one row per day), never by the number of events behind it, because gains are
summed per day by a partial aggregate first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _by_day():
    return Window.partitionBy("series_id").orderBy("day")


def cumulative_points(gains: DataFrame) -> DataFrame:
    """``(series_id, day, gain)`` rows, several per day allowed, as ``(series_id, day, cum)``.

    Null ids, days and gains are left out; an empty table gives an empty series.
    """
    days = gains.where("series_id IS NOT NULL AND day IS NOT NULL AND gain IS NOT NULL").groupBy("series_id", "day").agg(F.sum("gain").cast("bigint").alias("gain"))
    return days.select("series_id", "day", F.sum("gain").over(_by_day().rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))


def fill_daily(points: DataFrame, end: Column) -> DataFrame:
    """A gap-free daily series from the first point to ``end``; each day has the last value known at its end.

    No calendar join: every point is repeated up to the day before the next one. Points after ``end`` are ignored.
    """
    until = F.coalesce(F.date_sub(F.lead("day").over(_by_day()), 1), end)
    known = points.where(F.col("day") <= end)
    return known.select("series_id", "day", "cum", until.alias("until")).select(
        "series_id", F.explode(F.sequence("day", F.greatest("day", "until"))).alias("day"), "cum"
    )


# Days of history that a baseline needs, the gain that counts before that, and what a gain must reach later.
LEAST_HISTORY, FIRST_GAIN, FLOOR_GAIN, FLOOR_SHARE, TIMES_BASELINE, OVER_BASELINE = 7, 20.0, 5.0, 0.002, 4, 2


def floor_gain(total, larger):
    """The least gain that can be a spike after ``total``: for columns or numbers, with ``larger`` of that kind."""
    return larger(FLOOR_GAIN, total * FLOOR_SHARE)


def spike_gain(history, baseline, floor, larger, choose):
    """The gain from which a day is a spike: for columns or numbers, with ``larger`` and ``choose`` of that kind."""
    return choose(history < LEAST_HISTORY, larger(FIRST_GAIN, floor), larger(baseline * TIMES_BASELINE + OVER_BASELINE, floor))


def spikes(daily: DataFrame) -> DataFrame:
    """Gain, trailing baseline (mean of the 28 days before) and spike flag of each day of a gap-free series.

    The first day's gain is its whole value. With fewer than 7 days of history only a gain of 20 or more counts; later a
    gain must reach the floor and four times the baseline plus 2. The floor is 5 or 0.2 % of the total of the day before.
    """
    prev = F.coalesce(F.lag("cum").over(_by_day()), F.lit(0))
    first = F.row_number().over(_by_day()) == 1
    g = daily.select("series_id", "day", "cum", prev.alias("cum_prev"), F.when(first, F.col("cum")).otherwise(F.greatest(F.lit(0), F.col("cum") - prev)).alias("gain"))
    trailing = _by_day().rowsBetween(-28, -1)
    base = F.coalesce(F.sum("gain").over(trailing) / F.count("gain").over(trailing), F.lit(0.0))
    larger = lambda x, y: F.greatest(x if isinstance(x, Column) else F.lit(x), y)
    g = g.select("*", base.alias("baseline"), F.count("gain").over(trailing).alias("history"), floor_gain(F.col("cum_prev"), larger).alias("floor"))
    spike = F.col("gain") >= spike_gain(F.col("history"), F.col("baseline"), F.col("floor"), larger, lambda c, x, y: F.when(c, x).otherwise(y))
    return g.withColumn("spike", spike)


_RUN = "STRUCT<b: DATE, e: DATE, delta: BIGINT, pend: BIGINT, base: DOUBLE, tail: DOUBLE, peak: BIGINT, peak_day: DATE, cum_end: BIGINT>"
# One pass with the open run as state: extend it over at most two quiet days and while it is under 20 days long; a day that
# closes a run may open the next one.
_FOLD = f"""
aggregate(days,
  named_struct('s', CAST(NULL AS {_RUN}), 'out', CAST(array() AS ARRAY<{_RUN}>)),
  (a, x) -> CASE
    WHEN a.s IS NOT NULL AND datediff(x.day, a.s.e) <= 3 AND datediff(a.s.e, a.s.b) < 20 THEN
      CASE WHEN x.spike OR x.gain > a.s.tail THEN named_struct('s', named_struct('b', a.s.b, 'e', x.day,
             'delta', a.s.delta + a.s.pend + x.gain, 'pend', 0L, 'base', a.s.base, 'tail', a.s.tail,
             'peak', greatest(a.s.peak, x.gain), 'peak_day', CASE WHEN x.gain > a.s.peak THEN x.day ELSE a.s.peak_day END,
             'cum_end', x.cum), 'out', a.out)
           ELSE named_struct('s', named_struct('b', a.s.b, 'e', a.s.e, 'delta', a.s.delta, 'pend', a.s.pend + x.gain,
             'base', a.s.base, 'tail', a.s.tail, 'peak', a.s.peak, 'peak_day', a.s.peak_day, 'cum_end', a.s.cum_end), 'out', a.out) END
    ELSE named_struct('s', CASE WHEN x.spike THEN named_struct('b', x.day, 'e', x.day, 'delta', x.gain, 'pend', 0L,
             'base', x.baseline, 'tail', greatest(2 * x.baseline, x.floor / 2), 'peak', x.gain, 'peak_day', x.day, 'cum_end', x.cum)
             ELSE CAST(NULL AS {_RUN}) END,
           'out', CASE WHEN a.s IS NULL THEN a.out ELSE concat(a.out, array(a.s)) END) END,
  a -> CASE WHEN a.s IS NULL THEN a.out ELSE concat(a.out, array(a.s)) END)
"""


def growth_episodes(daily: DataFrame, top: int | None = 8) -> DataFrame:
    """Runs of unusual growth in gap-free series: ``series_id, start_day, end_day, delta, peak_day, peak_value,
    baseline_per_day, excess, cum_end``.

    A run is kept if its gain beyond the baseline is at least 15 and 0.5 % of the total at its end. ``top`` keeps the runs
    of each series with most excess, earlier ones at a tie; None keeps all. Series under three days have none. The state is
    folded inside the JVM over the days of one series, so no row leaves it.
    """
    s = spikes(daily)
    day = F.struct("day", "gain", "cum", "baseline", "floor", "spike")
    packed = s.groupBy("series_id").agg(F.sort_array(F.collect_list(day)).alias("days")).where(F.size("days") >= 3)
    runs = packed.select("series_id", F.explode(F.expr(_FOLD)).alias("r"))
    excess = F.col("r.delta") - F.col("r.base") * (F.datediff("r.e", "r.b") + 1)
    out = runs.select(
        "series_id", F.col("r.b").alias("start_day"), F.col("r.e").alias("end_day"), F.col("r.delta").alias("delta"), F.col("r.peak_day").alias("peak_day"),
        F.col("r.peak").alias("peak_value"), F.round("r.base", 2).alias("baseline_per_day"), F.round(excess, 6).alias("excess"), F.col("r.cum_end").alias("cum_end"),
    ).where(F.col("excess") >= F.greatest(F.lit(15.0), F.col("cum_end") * 0.005))
    if top is None:
        return out
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("excess"), "start_day"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def value_at(points: DataFrame, asks: DataFrame, interpolate: bool = False) -> DataFrame:
    """As-of lookup: ``asks (series_id, day, ...)`` with ``value``, the total at the end of ``day``.

    Before the first point: 0, or null if ``interpolate``; after the last: the last value; between two points: the earlier,
    or their linear interpolation rounded half to even. A series without points gives null. Both sides are sorted together
    by series and day, so there is no range join.
    """
    side = asks.select("series_id", "day", F.struct(*[F.col(c) for c in asks.columns]).alias("ask")).withColumn("p", F.lit(None).cast("struct<d:date,v:bigint>"))
    rows = points.select("series_id", "day", F.lit(None).cast(side.schema["ask"].dataType).alias("ask"), F.struct(F.col("day").alias("d"), F.col("cum").cast("bigint").alias("v")).alias("p")).unionByName(side)
    order = Window.partitionBy("series_id").orderBy("day", F.col("ask").isNotNull())
    back = Window.partitionBy("series_id").orderBy(F.desc("day"), F.col("ask").isNull())
    before = F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    r = rows.select("*", before.alias("b"), after.alias("a")).where("ask IS NOT NULL")
    if interpolate:
        share = F.datediff("day", "b.d") / F.greatest(F.lit(1), F.datediff("a.d", "b.d"))
        value = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("a").isNull(), F.col("b.v")).otherwise(F.bround(F.col("b.v") + (F.col("a.v") - F.col("b.v")) * share, 0))
    else:
        value = F.when(F.col("b").isNotNull(), F.col("b.v")).when(F.col("a").isNotNull(), F.lit(0))
    return r.select("ask.*", value.cast("bigint").alias("value"))


def snapshots(daily: DataFrame, longest: int = 1100, step: int = 7) -> DataFrame:
    """A series of up to ``longest`` days whole; of longer ones every ``step``-th day and the last."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    k = F.row_number().over(_by_day())
    return daily.select("series_id", "day", "cum", n.alias("n"), k.alias("k")).where((F.col("n") <= longest) | ((F.col("k") - 1) % step == 0) | (F.col("k") == F.col("n"))).select("series_id", "day", "cum")


def dense_tail(points: DataFrame, gap: int = 2, least: int = 14) -> DataFrame:
    """The last stretch of points at most ``gap`` days apart, without its first point, if ``least`` points remain.

    Series under three points have none.
    """
    spaced = points.select("series_id", "day", "cum", F.datediff("day", F.lag("day").over(_by_day())).alias("gap"))
    whole = Window.partitionBy("series_id")
    cutoff = F.coalesce(F.max(F.when(F.col("gap") > gap, F.col("day"))).over(whole), F.min("day").over(whole))
    tail = spaced.select("series_id", "day", "cum", cutoff.alias("cutoff"), F.count(F.lit(1)).over(whole).alias("n")).where((F.col("day") > F.col("cutoff")) & (F.col("n") >= 3))
    return tail.withColumn("left", F.count(F.lit(1)).over(whole)).where(F.col("left") >= least).select("series_id", "day", "cum")


def durability(daily: DataFrame, episodes: DataFrame, first: int = 31, last: int = 90) -> DataFrame:
    """Pace in days ``first``..``last`` after each episode against its baseline: ``after_per_day`` and ``verdict``
    (``above``, ``close``, ``below``, ``from_nothing`` or ``too_recent``)."""
    asks = episodes.select("series_id", "start_day", "end_day", "baseline_per_day", F.date_add("end_day", first - 1).alias("d0"), F.date_add("end_day", last).alias("d1"))
    known = daily.select("series_id", F.col("day"), F.col("cum"))
    r = (
        asks.join(known.select("series_id", F.col("day").alias("d0"), F.col("cum").alias("c0")), ["series_id", "d0"], "left")
        .join(known.select("series_id", F.col("day").alias("d1"), F.col("cum").alias("c1")), ["series_id", "d1"], "left")
    )
    pace = (F.col("c1") - F.col("c0")) / (last - first + 1)
    ratio = F.col("after_per_day") / F.col("baseline_per_day")
    verdict = (
        F.when(F.col("after_per_day").isNull(), "too_recent").when(F.col("baseline_per_day") < 0.5, "from_nothing")
        .when(ratio >= 1.5, "above").when(ratio >= 0.67, "close").otherwise("below")
    )
    return r.withColumn("after_per_day", F.round(pace, 6)).select("series_id", "start_day", "end_day", "after_per_day", verdict.alias("verdict"))


def recent_gain(points: DataFrame, days: int = 90) -> DataFrame:
    """Last total of each series and its gain over the last ``days`` days before its last point."""
    end = points.groupBy("series_id").agg(F.max("day").alias("last_day"), F.max_by("cum", "day").alias("last_cum"))
    asked = value_at(points, end.select("series_id", F.date_sub("last_day", days).alias("day"), "last_day", "last_cum"))
    return asked.select("series_id", "last_day", "last_cum", (F.col("last_cum") - F.col("value")).alias("gain"))


def sampling_step(points: DataFrame) -> DataFrame:
    """The upper median distance between points of each series and its name: day, week or period."""
    gaps = points.select("series_id", F.datediff("day", F.lag("day").over(_by_day())).alias("gap")).where("gap IS NOT NULL")
    m = gaps.groupBy("series_id").agg(F.sort_array(F.collect_list("gap")).alias("g")).select("series_id", F.expr("g[CAST(floor(size(g) / 2) AS INT)]").alias("median_gap"))
    return m.withColumn("step", F.when(F.col("median_gap") <= 1, "day").when(F.col("median_gap") <= 8, "week").otherwise("period"))


def thin(points: DataFrame, most: int = 80) -> DataFrame:
    """About ``most`` evenly spaced points of each series, always with the last."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    k = F.row_number().over(_by_day())
    r = points.select("series_id", "day", "cum", n.alias("n"), k.alias("k"))
    return r.where(((F.col("k") - 1) % F.greatest(F.lit(1), F.ceil(F.col("n") / most)) == 0) | (F.col("k") == F.col("n"))).select("series_id", "day", "cum")


def chart_segments(points: DataFrame, wide: int = 45) -> DataFrame:
    """Each point with the gain since the one before, their distance in days, and whether the line between is a guess."""
    gap = F.datediff("day", F.lag("day").over(_by_day()))
    return points.select(
        "series_id", "day", "cum", F.greatest(F.lit(0), F.col("cum") - F.coalesce(F.lag("cum").over(_by_day()), F.lit(0))).alias("gain"),
        gap.alias("gap"), F.coalesce(gap > wide, F.lit(False)).alias("dashed"),
    )
