"""Joins on time intervals: range, first-match and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _buckets(start: Column, end: Column, width: int) -> Column:
    origin = F.lit("1970-01-01").cast("date")
    return F.explode(F.sequence(F.floor(F.datediff(start, origin) / width), F.floor(F.datediff(end, origin) / width)))


def join_intervals(left: DataFrame, right: DataFrame, keys: list[str], width: int = 32) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``keys`` whose days overlap, both ends included.

    Intervals are ``l_start, l_end`` and ``r_start, r_end``; rows with a null end or an end before its start match nothing.
    Time is cut into buckets of ``width`` days that join by equality, so that a busy key is spread over its buckets; an
    overlap counts only in the bucket in which it begins, so no pair comes twice.
    """
    a = left.where("l_start <= l_end").withColumn("bucket", _buckets(F.col("l_start"), F.col("l_end"), width))
    b = right.where("r_start <= r_end").withColumn("bucket", _buckets(F.col("r_start"), F.col("r_end"), width))
    begins = F.floor(F.datediff(F.greatest("l_start", "r_start"), F.lit("1970-01-01").cast("date")) / width)
    overlap = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) & (F.col("bucket") == begins)
    return a.join(b, [*keys, "bucket"]).where(overlap).drop("bucket")


def within_intervals(left: DataFrame, right: DataFrame, keys: list[str], width: int = 32) -> DataFrame:
    """Rows of ``left`` (with ``l_id``) that overlap any interval of ``right``: a range semi-join."""
    hit = join_intervals(left.select(*keys, "l_id", "l_start", "l_end"), right.select(*keys, "r_start", "r_end"), keys, width).select("l_id").distinct()
    return left.join(hit, "l_id", "left_semi")


def first_interval(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], width: int = 32) -> DataFrame:
    """Each left row (``l_id``) with the first right interval, by ``order``, that holds its start."""
    points = left.withColumn("l_end", F.col("l_start"))
    rank = F.row_number().over(Window.partitionBy("l_id").orderBy(*order))
    return join_intervals(points, right, keys, width).withColumn("rank", rank).where("rank = 1").drop("rank")
