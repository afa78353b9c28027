"""Queries on daily series, growth episodes and launches.

Test series: purchases of each user in ``events`` (30 days) and orders of each priority in ``orders`` (over six years).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import launches as L
from fathomline.operators import series as S
from fathomline.operators.intervals import join_intervals
from fathomline.plans.registry import core
from fathomline.sources.tables import table

END = "2024-01-30"


def purchases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return S.cumulative_points(e.select(F.col("user_id").alias("series_id"), F.col("ts").cast("date").alias("day"), F.floor("value").alias("gain")))


def order_points(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return S.cumulative_points(o.select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("day"), F.lit(1).alias("gain")))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return S.fill_daily(purchases(spark, d), F.lit(END).cast("date"))


POINTS = """
g AS (SELECT user_id AS series_id, CAST(ts AS DATE) AS day, sum(CAST(floor(value) AS BIGINT)) AS gain FROM events
      WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
points AS (SELECT series_id, day, CAST(sum(gain) OVER (PARTITION BY series_id ORDER BY day) AS BIGINT) AS cum FROM g)"""
DAILY = POINTS + f""",
daily AS (SELECT series_id, CAST(unnest(generate_series(day, until, INTERVAL 1 DAY)) AS DATE) AS day, cum FROM (
  SELECT series_id, day, cum, coalesce(CAST(lead(day) OVER (PARTITION BY series_id ORDER BY day) - INTERVAL 1 DAY AS DATE), DATE '{END}') AS until FROM points))"""
SPIKES = DAILY + """,
g1 AS (SELECT *, coalesce(lag(cum) OVER w, 0) AS cum_prev, CASE WHEN row_number() OVER w = 1 THEN cum ELSE greatest(0, cum - lag(cum) OVER w) END AS gain
       FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY day)),
g2 AS (SELECT *, coalesce(CAST(sum(gain) OVER w AS DOUBLE) / nullif(count(gain) OVER w, 0), 0) AS baseline, count(gain) OVER w AS history,
       greatest(5.0, cum_prev * CAST(0.002 AS DOUBLE)) AS floor FROM g1
       WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
spk AS (SELECT *, CASE WHEN history < 7 THEN gain >= greatest(20.0, floor) ELSE gain >= floor AND gain >= 4 * baseline + 2 END AS spike FROM g2)"""
EPISODES = SPIKES + """,
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS rn, count(*) OVER (PARTITION BY series_id) AS len FROM spk),
st AS (
  SELECT series_id, rn, len, spike AS open, day AS b, day AS e, CAST(gain AS BIGINT) AS delta, CAST(0 AS BIGINT) AS pend, baseline AS base,
         greatest(2 * baseline, floor / 2) AS tail, CAST(gain AS BIGINT) AS peak, day AS peak_day, cum AS cum_end,
         false AS out, day AS ob, day AS oe, CAST(0 AS BIGINT) AS odelta, CAST(0 AS DOUBLE) AS obase, CAST(0 AS BIGINT) AS opeak, day AS opeak_day, CAST(0 AS BIGINT) AS ocum
  FROM n WHERE rn = 1 AND len >= 3
  UNION ALL
  SELECT n.series_id, n.rn, n.len, CASE WHEN go THEN true ELSE n.spike END,
    CASE WHEN go THEN b ELSE n.day END, CASE WHEN go AND NOT ext THEN e ELSE n.day END,
    CASE WHEN go AND ext THEN delta + pend + n.gain WHEN go THEN delta ELSE n.gain END,
    CASE WHEN go AND NOT ext THEN pend + n.gain ELSE 0 END, CASE WHEN go THEN base ELSE n.baseline END,
    CASE WHEN go THEN tail ELSE greatest(2 * n.baseline, n.floor / 2) END,
    CASE WHEN go THEN greatest(peak, CASE WHEN ext THEN n.gain ELSE peak END) ELSE n.gain END,
    CASE WHEN go AND NOT (ext AND n.gain > peak) THEN peak_day ELSE n.day END, CASE WHEN go AND NOT ext THEN cum_end ELSE n.cum END,
    open AND NOT go, b, e, delta, base, peak, peak_day, cum_end
  FROM (SELECT st.*, n2.day AS nday, st.open AND n2.day - st.e <= 3 AND st.e - st.b < 20 AS go, n2.spike OR n2.gain > st.tail AS ext
        FROM st JOIN n n2 ON n2.series_id = st.series_id AND n2.rn = st.rn + 1) x
  JOIN n ON n.series_id = x.series_id AND n.rn = x.rn + 1),
runs AS (
  SELECT series_id, ob AS b, oe AS e, odelta AS delta, obase AS base, opeak AS peak, opeak_day AS peak_day, ocum AS cum_end FROM st WHERE out
  UNION ALL SELECT series_id, b, e, delta, base, peak, peak_day, cum_end FROM st WHERE rn = len AND open),
kept AS (SELECT series_id, b AS start_day, e AS end_day, delta, peak_day, peak AS peak_value, round(base, 2) AS baseline_per_day,
         round(delta - base * (e - b + 1), 6) AS excess, cum_end FROM runs),
episodes AS (SELECT * FROM kept WHERE excess >= greatest(15.0, cum_end * CAST(0.005 AS DOUBLE)))"""
ORDER_POINTS = """
g AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS day, count(*) AS gain FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2),
points AS (SELECT series_id, day, CAST(sum(gain) OVER (PARTITION BY series_id ORDER BY day) AS BIGINT) AS cum FROM g)"""
_TOP = "SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY excess DESC, start_day) <= {}"


@core.query("daily_points", f"WITH {POINTS} SELECT * FROM points")
def daily_points(spark: SparkSession, d: str) -> DataFrame:
    """Running totals per user and day."""
    return purchases(spark, d)


@core.query("daily_series", f"WITH {DAILY} SELECT * FROM daily")
def daily_series(spark: SparkSession, d: str) -> DataFrame:
    """Gap-free daily totals."""
    return daily(spark, d)


@core.query("daily_spikes", f"WITH {SPIKES} SELECT series_id, day, CAST(gain AS BIGINT) AS gain, round(baseline, 6) AS baseline, spike FROM spk")
def daily_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Gains, trailing baselines and spike flags."""
    return S.spikes(daily(spark, d)).select("series_id", "day", F.col("gain").cast("bigint").alias("gain"), F.round("baseline", 6).alias("baseline"), "spike")


@core.query("growth_episodes", f"WITH RECURSIVE {EPISODES} {_TOP.format(8)}")
def growth_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The up to eight strongest growth episodes of each user."""
    return S.growth_episodes(daily(spark, d))


@core.query("growth_episodes_top2", f"WITH RECURSIVE {EPISODES} {_TOP.format(2)}")
def growth_episodes_top2(spark: SparkSession, d: str) -> DataFrame:
    """The two strongest growth episodes of each user."""
    return S.growth_episodes(daily(spark, d), top=2)


_ASKS = "asks AS (SELECT series_id, DATE '2023-12-31' + CAST(o AS INTEGER) AS day FROM (SELECT DISTINCT series_id FROM points), (VALUES (0), (7), (14), (21), (28), (35)) v(o))"


def _asks(points: DataFrame) -> DataFrame:
    offsets = F.explode(F.array(*[F.lit(o) for o in (0, 7, 14, 21, 28, 35)])).alias("o")
    return points.select("series_id").distinct().select("series_id", offsets).select("series_id", F.expr("date_add(DATE'2023-12-31', o)").alias("day"))


@core.query(
    "series_value_at",
    f"""WITH {POINTS}, {_ASKS} SELECT a.series_id, a.day, coalesce(max_by(p.cum, p.day), 0) AS value
    FROM asks a LEFT JOIN points p ON p.series_id = a.series_id AND p.day <= a.day GROUP BY 1, 2""",
)
def series_value_at(spark: SparkSession, d: str) -> DataFrame:
    """Totals at weekly dates: 0 before the first point, the last value after the last."""
    p = purchases(spark, d)
    return S.value_at(p, _asks(p))


@core.query(
    "series_value_interpolated",
    f"""WITH {POINTS}, {_ASKS},
    b AS (SELECT a.series_id, a.day, max_by(p.cum, p.day) AS v0, max(p.day) AS d0 FROM asks a LEFT JOIN points p ON p.series_id = a.series_id AND p.day <= a.day GROUP BY 1, 2),
    c AS (SELECT a.series_id, a.day, min_by(p.cum, p.day) AS v1, min(p.day) AS d1 FROM asks a LEFT JOIN points p ON p.series_id = a.series_id AND p.day >= a.day GROUP BY 1, 2)
    SELECT series_id, day, CAST(CASE WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
      ELSE round_even(v0 + (v1 - v0) * (CAST(day - d0 AS DOUBLE) / greatest(1, d1 - d0)), 0) END AS BIGINT) AS value FROM b JOIN c USING (series_id, day)""",
)
def series_value_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """Totals at weekly dates, interpolated between points; null before the first."""
    p = purchases(spark, d)
    return S.value_at(p, _asks(p), interpolate=True)


_ORDER_DAILY = ORDER_POINTS + """,
daily AS (SELECT series_id, CAST(unnest(generate_series(day, until, INTERVAL 1 DAY)) AS DATE) AS day, cum FROM (
  SELECT series_id, day, cum, coalesce(CAST(lead(day) OVER (PARTITION BY series_id ORDER BY day) - INTERVAL 1 DAY AS DATE), DATE '2001-08-01') AS until FROM points WHERE day <= DATE '2001-08-01'))"""


@core.query(
    "weekly_snapshots",
    f"""WITH {_ORDER_DAILY}, k AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY day) AS k FROM daily)
    SELECT series_id, day, cum FROM k WHERE n <= 1100 OR (k - 1) % 7 = 0 OR k = n""",
)
def weekly_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Weekly points of order series of more than 1,100 days, with the last day."""
    return S.snapshots(S.fill_daily(order_points(spark, d), F.lit("2001-08-01").cast("date")))


@core.query(
    "dense_tail",
    f"""WITH {POINTS}, s AS (SELECT *, day - lag(day) OVER (PARTITION BY series_id ORDER BY day) AS gap, count(*) OVER (PARTITION BY series_id) AS n FROM points),
    c AS (SELECT *, coalesce(max(CASE WHEN gap > 2 THEN day END) OVER (PARTITION BY series_id), min(day) OVER (PARTITION BY series_id)) AS cutoff FROM s)
    SELECT series_id, day, cum FROM c WHERE day > cutoff AND n >= 3 QUALIFY count(*) OVER (PARTITION BY series_id) >= 5""",
)
def dense_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last stretch of points at most two days apart, if five remain."""
    return S.dense_tail(purchases(spark, d), least=5)


@core.query(
    "episode_durability",
    f"""WITH RECURSIVE {EPISODES}, top AS ({_TOP.format(8)}), r AS (
      SELECT t.series_id, t.start_day, t.end_day, t.baseline_per_day AS b, round(CAST(d1.cum - d0.cum AS DOUBLE) / 7, 6) AS a FROM top t
      LEFT JOIN daily d0 ON d0.series_id = t.series_id AND d0.day = t.end_day + 3 LEFT JOIN daily d1 ON d1.series_id = t.series_id AND d1.day = t.end_day + 10)
    SELECT series_id, start_day, end_day, a AS after_per_day, CASE WHEN a IS NULL THEN 'too_recent' WHEN b < 0.5 THEN 'from_nothing'
      WHEN a / b >= 1.5 THEN 'above' WHEN a / b >= 0.67 THEN 'close' ELSE 'below' END AS verdict FROM r""",
)
def episode_durability(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pace of days 4 to 10 after an episode stayed above its baseline."""
    s = daily(spark, d)
    return S.durability(s, S.growth_episodes(s), first=4, last=10)


@core.query(
    "recent_gain",
    f"""WITH {ORDER_POINTS}, l AS (SELECT series_id, max(day) AS last_day, max_by(cum, day) AS last_cum FROM points GROUP BY 1)
    SELECT l.series_id, last_day, last_cum, last_cum - coalesce(max_by(p.cum, p.day), 0) AS gain
    FROM l LEFT JOIN points p ON p.series_id = l.series_id AND p.day <= last_day - 90 GROUP BY 1, 2, 3""",
)
def recent_gain(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each priority in the last 90 days of its series."""
    return S.recent_gain(order_points(spark, d))


@core.query(
    "sampling_step",
    f"""WITH {POINTS}, s AS (SELECT series_id, day - lag(day) OVER (PARTITION BY series_id ORDER BY day) AS gap FROM points),
    m AS (SELECT series_id, list_sort(list(gap))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median_gap FROM s WHERE gap IS NOT NULL GROUP BY 1)
    SELECT series_id, CAST(median_gap AS INTEGER) AS median_gap, CASE WHEN median_gap <= 1 THEN 'day' WHEN median_gap <= 8 THEN 'week' ELSE 'period' END AS step FROM m""",
)
def sampling_step(spark: SparkSession, d: str) -> DataFrame:
    """The upper median distance between points of each series."""
    return S.sampling_step(purchases(spark, d))


@core.query(
    "thin_series",
    f"""WITH {ORDER_POINTS}, k AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY day) AS k FROM points)
    SELECT series_id, day, cum FROM k WHERE (k - 1) % greatest(1, CAST(ceil(n / 80.0) AS BIGINT)) = 0 OR k = n""",
)
def thin_series(spark: SparkSession, d: str) -> DataFrame:
    """About 80 points of each order series for a small chart."""
    return S.thin(order_points(spark, d))


@core.query(
    "chart_segments",
    f"""WITH {POINTS} SELECT series_id, day, cum, greatest(0, cum - coalesce(lag(cum) OVER w, 0)) AS gain, CAST(day - lag(day) OVER w AS INTEGER) AS gap,
    coalesce(day - lag(day) OVER w > 5, false) AS dashed FROM points WINDOW w AS (PARTITION BY series_id ORDER BY day)""",
)
def chart_segments(spark: SparkSession, d: str) -> DataFrame:
    """Gains and dashed gaps of each series for a chart."""
    return S.chart_segments(purchases(spark, d), wide=5)


# Launches: signups are strong, errors only join; both from a value of 100 on.
_LAUNCH = """
ev AS (SELECT user_id AS series_id, event_id, CAST(ts AS DATE) AS day, event_type = 'signup' AS strong FROM events
       WHERE event_type IN ('signup', 'error') AND value >= 100 AND user_id IS NOT NULL AND ts IS NOT NULL),
s1 AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY series_id ORDER BY day, event_id) <= 4 THEN 0 ELSE 1 END AS opens FROM ev),
s2 AS (SELECT *, sum(opens) OVER (PARTITION BY series_id ORDER BY day, event_id) AS session FROM s1),
s3 AS (SELECT series_id, session, min(day) AS anchor, max(day) AS end_day, count(*) AS n_events, bool_or(strong) AS strong FROM s2 GROUP BY 1, 2),
clusters AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY anchor) AS INTEGER) AS cluster, anchor, end_day, n_events FROM s3 WHERE strong)"""
_OFFSETS = "(VALUES ('before', -1), ('+24h', 1), ('+48h', 2), ('+7d', 7), ('+30d', 30), ('+90d', 90)) v(label, o)"
_WINDOWS = _LAUNCH + "," + POINTS + f""",
asks AS (SELECT series_id, anchor, label, anchor + CAST(o AS INTEGER) AS day FROM clusters, {_OFFSETS} WHERE label = 'before' OR anchor + CAST(o AS INTEGER) <= DATE '{END}'),
known AS (SELECT DISTINCT series_id FROM points),
win AS (SELECT a.series_id, a.anchor, a.label, a.day, CASE WHEN k.series_id IS NULL THEN NULL ELSE coalesce(max_by(p.cum, p.day), 0) END AS value
        FROM asks a LEFT JOIN known k ON k.series_id = a.series_id LEFT JOIN points p ON p.series_id = a.series_id AND p.day <= a.day GROUP BY a.series_id, a.anchor, a.label, a.day, k.series_id)"""


def launch_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('signup', 'error') AND value >= 100")
    return e.select(F.col("user_id").alias("series_id"), "event_id", F.col("ts").cast("date").alias("day"), "event_type")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.cluster_launches(launch_events(spark, d), F.col("event_type") == "signup")


def windows(spark: SparkSession, d: str) -> DataFrame:
    return L.outcome_windows(clusters(spark, d), purchases(spark, d), F.lit(END).cast("date"))


@core.query("launch_clusters", f"WITH {_LAUNCH} SELECT series_id, cluster, anchor, end_day, n_events, cluster - 1 AS prior_launches FROM clusters")
def launch_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Launch clusters of each user with the number of launches before."""
    return clusters(spark, d)


@core.query("launch_members", f"WITH {_LAUNCH} SELECT s3.series_id, anchor, event_id FROM s3 JOIN s2 USING (series_id, session) WHERE s3.strong")
def launch_members(spark: SparkSession, d: str) -> DataFrame:
    """The events of each launch cluster."""
    return L.launch_members(launch_events(spark, d), F.col("event_type") == "signup")


@core.query("launch_windows", f"WITH {_WINDOWS} SELECT * FROM win")
def launch_windows(spark: SparkSession, d: str) -> DataFrame:
    """Totals before and after each launch."""
    return windows(spark, d)


@core.query(
    "launch_comparison",
    f"""WITH {_WINDOWS}, w AS (SELECT series_id, anchor, max(value) FILTER (label = 'before') AS before_value, max(value) FILTER (label = '+24h') AS a, max(value) FILTER (label = '+48h') AS b,
      max(value) FILTER (label = '+7d') AS c, max(value) FILTER (label = '+30d') AS e, max(value) FILTER (label = '+90d') AS f FROM win GROUP BY 1, 2)
    SELECT series_id, anchor, before_value, a - before_value AS gain_24h, b - before_value AS gain_48h, c - before_value AS gain_7d, e - before_value AS gain_30d, f - before_value AS gain_90d FROM w""",
)
def launch_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Launches side by side: gains at each window."""
    return L.compare_launches(windows(spark, d))


@core.query(
    "launch_summary",
    f"""WITH {_WINDOWS}, b AS (SELECT series_id, anchor, value AS base FROM win WHERE label = 'before' AND value IS NOT NULL)
    SELECT series_id, anchor, string_agg(label || ': ' || CAST(value - base AS VARCHAR), '; ' ORDER BY win.day) AS summary
    FROM win JOIN b USING (series_id, anchor) WHERE label <> 'before' AND value IS NOT NULL GROUP BY 1, 2""",
)
def launch_summary(spark: SparkSession, d: str) -> DataFrame:
    """One line per launch with its known gains."""
    return L.summarize_launches(windows(spark, d))


_NEAR = f"""WITH RECURSIVE {EPISODES}, top AS ({_TOP.format(8)}),
er AS (SELECT event_id, user_id AS series_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error' AND user_id IS NOT NULL),
near AS (SELECT t.series_id, t.start_day, t.end_day, er.event_id, er.day FROM top t JOIN er ON er.series_id = t.series_id AND er.day BETWEEN t.start_day - 3 AND t.end_day)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error' AND user_id IS NOT NULL").select("event_id", F.col("user_id").alias("series_id"), F.col("ts").cast("date").alias("l_start"))
    e = e.withColumn("l_end", F.col("l_start"))
    ep = S.growth_episodes(daily(spark, d)).select("series_id", "start_day", "end_day", F.date_sub("start_day", 3).alias("r_start"), F.col("end_day").alias("r_end"))
    return join_intervals(e, ep, ["series_id"])


@core.query("events_near_episodes", f"{_NEAR} SELECT * FROM near")
def events_near_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Events from three days before an episode to its end."""
    return _near(spark, d).select("series_id", "start_day", "end_day", "event_id", F.col("l_start").alias("day"))


@core.query(
    "unexplained_episodes",
    f"{_NEAR} SELECT t.series_id, t.start_day, t.end_day, count(near.event_id) AS n_related, CASE WHEN count(near.event_id) > 0 THEN 'weakly_associated' ELSE 'unknown' END AS attribution "
    "FROM top t LEFT JOIN near ON near.series_id = t.series_id AND near.start_day = t.start_day GROUP BY 1, 2, 3",
)
def unexplained_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with the number of events near them; those without any are unexplained."""
    near = _near(spark, d).groupBy("series_id", "start_day").agg(F.count(F.lit(1)).alias("n"))
    ep = S.growth_episodes(daily(spark, d)).select("series_id", "start_day", "end_day").join(near, ["series_id", "start_day"], "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return ep.select("series_id", "start_day", "end_day", n.alias("n_related"), F.when(n > 0, "weakly_associated").otherwise("unknown").alias("attribution"))
