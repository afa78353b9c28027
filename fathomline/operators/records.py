"""Record-keeping operators: latest versions, first known values, ranked cuts, ordered list unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key: the one with the greatest ``by``, a further tie broken by the other columns in order.

    A maximum of structs, so a key that is repeated by a third of all rows is reduced before the shuffle. Null keys are a
    key of their own; null ``by`` loses to any other.
    """
    rest = [c for c in df.columns if c not in (*keys, by)]
    orderable = [c for c in rest if not df.schema[c].dataType.typeName().startswith(("map", "variant"))]
    held = F.max(F.struct(F.col(by), *[F.col(c) for c in orderable])).alias("_held")
    return df.groupBy(*keys).agg(held).select(*keys, F.col(f"_held.{by}").alias(by), *[F.col(f"_held.{c}").alias(c) for c in orderable])


def first_known(df: DataFrame, keys: list[str], by: str, columns: list[str]) -> DataFrame:
    """The first non-null value of each column per key, in the order of ``by``."""
    aggs = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(by), F.col(c)))).getField(c).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*aggs)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key with their rank. Spark keeps only ``most`` rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def remap(ids: Column, mapping: Column) -> Column:
    """An id list with mapped ids replaced, in order, without repeats."""
    return F.array_distinct(F.transform(ids, lambda x: F.coalesce(F.element_at(mapping, x), x)))


def ordered_union(lists: Column) -> Column:
    """A list of lists as one list, in order, without repeats."""
    return F.array_distinct(F.flatten(lists))
