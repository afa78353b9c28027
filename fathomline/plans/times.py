"""Queries of the time normaliser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.timestamps import micros_text, normalize_times, time_key
from fathomline.plans.registry import core
from fathomline.sources.tables import table


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, row_id: str, key: list[Column]) -> DataFrame:
        return frames[name].select(F.lit(name).alias("table_name"), F.col(row_id).cast("string").alias("row_id"), *key)

    frames = {n: table(spark, sf_dir, n) for n in ("extracted_claims", "reddit_posts", "search_results", "feed_items")}
    ntz = dict(frames["search_results"].dtypes)["retrieved_at"] == "timestamp_ntz"
    return reduce(
        DataFrame.unionByName,
        [
            part("extracted_claims", "claim_id", time_key("text", F.col("claim_date"))),
            part("reddit_posts", "id", time_key("epoch", F.col("created_utc").cast("string"))),
            part("search_results", "result_id", time_key("text", F.col("page_age"), ref_micros=micros_text(F.col("retrieved_at"), ntz))),
            part("feed_items", "item_id", time_key("text", F.col("published"), F.col("feed_tz"), F.col("feed_locale"))),
        ],
    )


@core.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the four time fields that name a time but are not stored in canonical form, with that form."""
    n = normalize_times(_fields(spark, sf_dir))
    seconds = (F.col("t_source") == "epoch") & (F.col("t_raw").cast("double") < 1e11)
    return n.where(F.col("t_canon").isNotNull() & ~seconds & (F.col("t_canon") != F.col("t_raw"))).select(
        "table_name", "row_id", F.col("t_canon").alias("canon")
    ).distinct()


@core.query("p4_precision_counts")
def p4_precision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field have which precision after normalisation; ``none`` where no time is named."""
    n = normalize_times(_fields(spark, sf_dir))
    size = F.length("t_canon")
    precision = (
        F.when(size == 4, "year").when(size == 7, "month").when(size == 10, "day").when(size == 20, "second").when(size == 21, "span").otherwise("none")
    )
    return n.groupBy("table_name", precision.alias("precision")).agg(F.count(F.lit(1)).alias("n_values"))
