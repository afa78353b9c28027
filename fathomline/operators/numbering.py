"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.session import cut


def number_rows(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with a row number from 1 in the order of ``order`` (which should have no ties).

    Rows are range-partitioned and numbered inside each partition; the sizes of the partitions before, a table of one row
    per partition, are added.
    """
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(p, *order).withColumn("_pid", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return placed.withColumn("_k", local).join(F.broadcast(before), "_pid").withColumn(name, F.col("_k") + F.col("_before")).drop("_pid", "_k", "_before")
