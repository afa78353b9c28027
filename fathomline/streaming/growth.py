"""Structured Streaming forms of the series operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomline.operators.series import floor_gain, spike_gain


def daily_gains(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Gains per series and day of ``(series_id, ts, gain)``; days close when the watermark passes them."""
    w = stream.withWatermark("ts", lateness).groupBy("series_id", F.window("ts", "1 day").alias("w")).agg(F.sum("gain").alias("gain"))
    return w.select("series_id", F.col("w.start").cast("date").alias("day"), "gain")


def launch_sessions(stream: DataFrame, gap: str = "4 days", lateness: str = "2 days") -> DataFrame:
    """Sessions of ``(series_id, ts, strong)`` with at most ``gap`` between events; those with a strong event are launches."""
    s = stream.withWatermark("ts", lateness).groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(F.col("strong").cast("int")).alias("strong"))
    return s.where("strong = 1").select("series_id", F.col("w.start").alias("anchor"), "n_events")


WINDOW = 28  # days of the trailing baseline


def totals_and_spikes(stream: DataFrame) -> DataFrame:
    """For a stream of daily gains ``(series_id, day, gain)`` in order of days: the running total and whether the day is a
    spike against the 28 days before, by the rule of ``operators.series``. A day that comes after a later one counts for the
    total from then on and is no spike. State is 28 gains and a total per series."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, days, last, gains = state.get if state.exists else (0, 0, None, [])
        recent = deque(gains, maxlen=WINDOW)
        out = []
        for pdf in batches:
            for day, gain in sorted(zip(pdf["day"], pdf["gain"].astype("int64"))):
                today = pd.Timestamp(day)
                late = last is not None and today <= pd.Timestamp(last)
                spike = False
                if not late:
                    quiet = 0 if last is None else (today - pd.Timestamp(last)).days - 1
                    recent.extend([0] * min(quiet, WINDOW))
                    days += quiet
                    mean = sum(recent) / len(recent) if recent else 0.0
                    spike = gain >= spike_gain(min(days, WINDOW), mean, floor_gain(total, max), max, lambda c, x, y: x if c else y)
                    recent.append(int(gain))
                    days, last = days + 1, str(today.date())
                total += int(gain)
                out.append((key[0], day, int(gain), total, bool(spike)))
        state.update((total, days, last, list(recent)))
        yield pd.DataFrame(out, columns=["series_id", "day", "gain", "cum", "spike"])

    return stream.groupBy("series_id").applyInPandasWithState(
        step, "series_id string, day date, gain bigint, cum bigint, spike boolean", "total bigint, seen bigint, last string, gains array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
