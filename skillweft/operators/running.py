"""Running totals over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweft.sources.staging import shared_path, staged


def running_sum(rows: DataFrame, order: str, value, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to this one in ``order``, whose values are distinct.

    Rows are dealt by ranges of ``order`` and written, so that a part's number stays what it is; each part is summed
    up on its own and shifted by the totals of the parts before it, of which there is a row each.
    """
    dealt = rows.withColumn("_v", value).repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    held = staged(dealt, shared_path(rows.sparkSession, "running"))
    parts = held.groupBy("_p").agg(F.sum("_v").alias("_t"))
    before = parts.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_b"))
    own = F.sum("_v").over(Window.partitionBy("_p").orderBy(order))
    return held.withColumn("_s", own).join(F.broadcast(before), "_p").withColumn(name, F.col("_s") + F.col("_b")).drop("_p", "_v", "_s", "_b")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """adds running numbers from 1 in ``order``, whose values are distinct."""
    return running_sum(rows, order, F.lit(1).cast("long"), name)
