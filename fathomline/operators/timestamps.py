"""Normalisation of mixed time texts through a dictionary of distinct values.

Rows are reduced to distinct (source, text, zone, month order, reference) keys by a partial aggregate, every key is parsed
once, parsed keys are appended to a Parquet dictionary, and the instants are joined back. Texts that make up a large share
of the rows join by broadcast (at most ``HOT_SHARE`` of them can exist), all others by a hash join.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.timestamps import canonical, canonical_epoch
from fathomline.session import scratch_path

KEY = ["t_source", "t_raw", "t_zone", "t_month_first", "t_ref"]
#: A key is hot from this share of all rows on, so that at most 1 / HOT_SHARE keys are hot and broadcast.
HOT_SHARE = 0.002
HOT_LEAST = 20_000
_SCHEMA = "t_source string, t_raw string, t_zone string, t_month_first boolean, t_ref string, t_n bigint, t_canon string"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros_text(ts: Column, ntz: bool = False) -> Column:
    """A timestamp as decimal microseconds since 1970 UTC, whatever the session's time zone."""
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("string")
    return F.unix_micros(ts).cast("string")


def time_key(
    source: str, raw: Column, zone: Column | None = None, locale: Column | None = None, ref_micros: Column | None = None
) -> list[Column]:
    """The key columns of one time field. ``source``: ``epoch`` for numbers cast to text, any other name for texts.

    The reference moment is part of the key only for relative ages, so that absolute texts stay few.
    """
    relative = F.lower(raw).rlike(r"\sago\s*$")
    return [
        F.lit(source).alias("t_source"),
        raw.alias("t_raw"),
        (F.coalesce(zone, F.lit("")) if zone is not None else F.lit("")).alias("t_zone"),
        (F.coalesce(F.lower(locale) == "en-us", F.lit(False)) if locale is not None else F.lit(False)).alias("t_month_first"),
        (F.when(relative, F.coalesce(ref_micros, F.lit(""))).otherwise("") if ref_micros is not None else F.lit("")).alias("t_ref"),
    ]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        out = []
        for source, raw, zone, month_first, ref in zip(*cols):
            if source == "epoch":
                out.append(canonical_epoch(float(raw)))
            else:
                out.append(canonical(raw, zone or None, month_first, _EPOCH + timedelta(microseconds=int(ref)) if ref else None))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "t_canon"])


class TimestampDictionary:
    """Distinct time texts with their canonical forms, kept as Parquet and extended only by unseen keys."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "times")

    def read(self) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def update(self, keyed: DataFrame) -> DataFrame:
        """Parse the keys of ``keyed`` that are not there yet, append them and return the dictionary."""
        new = keyed.where(F.col("t_raw").isNotNull()).groupBy(*KEY).agg(F.count(F.lit(1)).alias("t_n"))
        if (old := self.read()) is not None:
            new = new.join(old.select(*KEY), KEY, "left_anti")
        new.mapInArrow(_parse, _SCHEMA).write.mode("append").parquet(self.path)
        return self.read()


def normalize_times(keyed: DataFrame, dictionary: TimestampDictionary | None = None) -> DataFrame:
    """``keyed`` (any columns and those of ``time_key``) with ``t_canon``.

    Null texts and texts that name no time get null; repeated rows are kept; an empty table gives an empty result. Other
    columns may have any names that do not start with ``t_``.
    """
    d = (dictionary or TimestampDictionary(keyed.sparkSession)).update(keyed)
    # Counts are of the rows that first brought a key; a key that becomes hot later is still split by AQE's skew join.
    total = d.agg(F.sum("t_n")).first()[0] or 0
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = d.where(F.col("t_n") >= least)
    known = keyed.where(F.col("t_raw").isNotNull())
    none = keyed.where(F.col("t_raw").isNull()).withColumn("t_canon", F.lit(None).cast("string"))
    if not d.where(F.col("t_n") >= least).limit(1).count():
        return known.join(d.drop("t_n"), KEY, "left").unionByName(none)
    heavy = F.broadcast(hot.select(*KEY, F.col("t_canon").alias("t_hot"), F.lit(True).alias("t_is_hot")))
    marked = known.join(heavy, KEY, "left")
    fast = marked.where("t_is_hot").withColumn("t_canon", F.col("t_hot")).drop("t_hot", "t_is_hot")
    rest = marked.where("t_is_hot IS NULL").drop("t_hot", "t_is_hot").join(d.where(F.col("t_n") < least).drop("t_n"), KEY, "left")
    return fast.unionByName(rest).unionByName(none)
