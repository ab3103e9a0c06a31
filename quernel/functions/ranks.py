"""Running sums over a whole frame without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.plans.lineage import stored


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before this one in `order` (values of `order` must differ). Rows are dealt by
    range; each range sums its own, and the sums of the ranges before it, one row per range, are added."""
    dealt = stored(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(order)) - F.col(value)
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")
