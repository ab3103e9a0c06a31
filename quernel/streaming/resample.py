"""Time aggregations over an unbounded event stream: what `resample` gives in batch, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sales(events: DataFrame, width: str = "1 day", late: str = "1 day", time: str = "event_time") -> DataFrame:
    """(start, sales, n, users): purchases by tumbling window. Users are counted approximately, since an exact distinct count
    would keep every user of a window in state."""
    bought = events.withColumn(time, F.col(time).cast("timestamp")).where((F.col("event_type") == "purchase") & (F.col("price") > 0))
    sums = bought.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.round(F.sum("price"), 4).alias("sales"), F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("users"))
    return sums.select(F.col("w.start").alias("start"), "sales", "n", "users")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", time: str = "event_time") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col("user_id").isNotNull())
    found = stamped.withWatermark(time, late).groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
