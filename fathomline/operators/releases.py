"""Release selection: first and last stable versions, version jumps and releases near growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.operators.intervals import within_intervals

VERSION = r"(\d+)\.(\d+)(?:\.(\d+))?"


def version(tag: Column) -> Column:
    """(major, minor, patch) of a tag; null if it names no version."""
    part = [F.regexp_extract(tag, VERSION, i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.struct(*[F.coalesce(p.try_cast("int"), F.lit(0)).alias(n) for p, n in zip(part, ("major", "minor", "patch"))]))


def version_jumps(releases: DataFrame) -> DataFrame:
    """Stable releases ``(target_key, id, tag, at)`` with a higher major, or minor before 1.0, than the versioned release before."""
    w = Window.partitionBy("target_key").orderBy("at", "id")
    v = releases.withColumn("v", version(F.col("tag")))
    v = v.withColumn("p", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    jump = F.col("p").isNull() | (F.col("v.major") > F.col("p.major")) | ((F.col("v.major") == 0) & (F.col("v.minor") > F.col("p.minor")))
    return v.where(F.col("v").isNotNull() & jump).drop("v", "p")


def select_releases(releases: DataFrame, episodes: DataFrame, most: int = 25) -> DataFrame:
    """At most ``most`` telling releases of each target: the first and last stable one, version jumps, and those from three
    days before an episode to its end. Beyond ``most``, the first, the last, major versions and then the earliest others.

    releases: ``target_key, id, tag, at, day, prerelease``; episodes: ``target_key, start_day, end_day``. Undated releases
    are left out.
    """
    dated = releases.where("at IS NOT NULL AND target_key IS NOT NULL")
    stable = dated.where(~F.coalesce("prerelease", F.lit(False)))
    ends = stable.groupBy("target_key").agg(F.min(F.struct("at", "id")).getField("id").alias("a"), F.max(F.struct("at", "id")).getField("id").alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("id"))
    spans = episodes.select("target_key", F.date_sub("start_day", 3).alias("r_start"), F.col("end_day").alias("r_end"))
    near = within_intervals(dated.select("target_key", F.col("id").alias("l_id"), F.col("day").alias("l_start"), F.col("day").alias("l_end")), spans, ["target_key"]).select(F.col("l_id").alias("id"))
    keep = dated.join(ends.unionByName(version_jumps(stable).select("id")).unionByName(near).distinct(), "id", "left_semi")
    w = Window.partitionBy("target_key")
    v = keep.withColumn("v", version(F.col("tag"))).withColumn("up", F.row_number().over(w.orderBy("at", "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    major = F.col("v").isNull() | ((F.col("v.minor") == 0) & (F.col("v.patch") == 0))
    rank = F.when((F.col("up") == 1) | (F.col("up") == F.col("n")), 0).when(major, 1).otherwise(2)
    return v.withColumn("place", F.row_number().over(w.orderBy(rank, "at", "id"))).where(F.col("place") <= most).select("target_key", "id", "tag", "at")
