"""Pairing of records with the nearest record in time of the same entity.

Both sides are range-partitioned together by (entity, time), so that an entity larger than one task spans several
partitions. Each partition is scanned locally for the last right record before and the first after each left record. Right
records at partition edges (at most two entities per partition) are exchanged through a two-level prefix scan over the
partition summaries, whose size is the number of partitions, not of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.session import cut

_RIGHT, _LEFT = 0, 1


def nearest_in_time(
    left: DataFrame, right: DataFrame, keys: list[str], tolerance: int | str, partitions: int | None = None, keep_unmatched: bool = False
) -> DataFrame:
    """The nearest ``right`` record of each ``left`` record with the same ``keys``.

    left: key columns, ``l_id``, ``l_time`` (microseconds) and, if ``tolerance`` is a column name, that column.
    right: key columns, ``r_id``, ``r_time``. Other columns are ignored, whatever their names.
    Returns the keys, ``l_id``, ``l_time``, ``r_id``, ``r_time``: one row per distinct left record with a match, or per
    left record if ``keep_unmatched``. At equal distance the earlier right record wins, then the smaller ``r_id``. Records
    with a null key, id or time match nothing; repeated rows count once; empty tables give an empty result (or unmatched rows).
    """
    spark = left.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tol = F.col(tolerance) if isinstance(tolerance, str) else F.lit(tolerance)
    none_s, none_l = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    l_rows = left.select(*keys, F.col("l_time").cast("bigint").alias("t"), F.lit(_LEFT).alias("side"), F.col("l_id").cast("string").alias("l_id"), none_s.alias("r_id"), tol.cast("bigint").alias("tol"))
    r_rows = right.select(*keys, F.col("r_time").cast("bigint").alias("t"), F.lit(_RIGHT).alias("side"), none_s.alias("l_id"), F.col("r_id").cast("string").alias("r_id"), none_l.alias("tol"))
    l_ok = l_rows.where(whole & F.col("t").isNotNull() & F.col("l_id").isNotNull())
    r_ok = r_rows.where(whole & F.col("t").isNotNull() & F.col("r_id").isNotNull())
    # One row per instant on the right (its smallest id) and per record on the left: repeats end here, before the exchange.
    rows = l_ok.unionByName(r_ok).groupBy(*keys, "t", "side", "l_id").agg(F.min("r_id").alias("r_id"), F.max("tol").alias("tol"))
    placed = cut(rows.repartitionByRange(p, *keys, "t", "side", "l_id").withColumn("pid", F.spark_partition_id()), "ranges")

    right_rec = F.when(F.col("side") == _RIGHT, F.struct("t", "r_id"))
    at = Window.partitionBy("pid", *keys)
    back = at.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = at.orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = (
        placed.withColumn("before", F.last(right_rec, ignorenulls=True).over(back))
        .withColumn("after", F.last(right_rec, ignorenulls=True).over(ahead))
        .where(F.col("side") == _LEFT)
    )
    carried = scanned.join(F.broadcast(_edges(placed, keys, right_rec, p)), ["pid", *keys], "left")
    before = F.coalesce("before", "carry_before")
    after = F.coalesce("after", "carry_after")
    d_before, d_after = F.col("t") - before["t"], after["t"] - F.col("t")
    ok_before = before.isNotNull() & (d_before <= F.col("tol"))
    ok_after = after.isNotNull() & (d_after <= F.col("tol"))
    best: Column = F.when(ok_before & (~F.coalesce(ok_after, F.lit(False)) | (d_before <= d_after)), before).when(ok_after, after)
    out = carried.withColumn("best", best).select(
        *keys, "l_id", F.col("t").alias("l_time"), F.col("best.r_id").alias("r_id"), F.col("best.t").alias("r_time")
    )
    if not keep_unmatched:
        return out.where(F.col("r_id").isNotNull())
    lost = l_rows.where(~(whole & F.col("t").isNotNull() & F.col("l_id").isNotNull()))
    return out.unionByName(lost.select(*keys, "l_id", F.col("t").alias("l_time"), none_s.alias("r_id"), none_l.alias("r_time")))


def _edges(placed: DataFrame, keys: list[str], right_rec: Column, p: int) -> DataFrame:
    """For every partition and entity that continues from or into another partition: the last right record of the
    partitions before and the first of those after. At most two rows per partition."""
    key = F.struct(*keys)
    ends = placed.groupBy("pid").agg(F.min(key).alias("first_k"), F.max(key).alias("last_k"))
    part = placed.groupBy("pid", *keys).agg(F.min(right_rec).alias("lo"), F.max(right_rec).alias("hi"))
    at_edge = part.join(F.broadcast(ends), "pid").where((key == F.col("first_k")) | (key == F.col("last_k")))
    block = math.isqrt(p) + 1
    s = at_edge.select("pid", *keys, "lo", "hi", (F.col("pid") / block).cast("int").alias("block"))
    # Level 1: exclusive scans inside each block of partitions. Level 2: exclusive scans over the block totals.
    totals = s.groupBy("block", *keys).agg(F.min("lo").alias("b_lo"), F.max("hi").alias("b_hi"))
    over_blocks = Window.partitionBy(*keys).orderBy("block")
    totals = totals.select(
        "block", *keys,
        F.max("b_hi").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("blocks_before"),
        F.min("b_lo").over(Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)).alias("blocks_after"),
    )
    inside = Window.partitionBy("block", *keys)
    s = s.select(
        "pid", "block", *keys,
        F.max("hi").over(inside.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("in_before"),
        F.min("lo").over(inside.orderBy(F.desc("pid")).rowsBetween(Window.unboundedPreceding, -1)).alias("in_after"),
    )
    return (
        s.join(totals, ["block", *keys])
        .select("pid", *keys, F.coalesce("in_before", "blocks_before").alias("carry_before"), F.coalesce("in_after", "blocks_after").alias("carry_after"))
        .where("carry_before IS NOT NULL OR carry_after IS NOT NULL")
    )
