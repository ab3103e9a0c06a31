"""Tables that describe clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(feature: str, digits: int) -> Column:
    r = lambda x: F.round(x, digits)
    q = lambda p: r(F.percentile(feature, F.lit(p)))
    return F.struct(F.lit(feature).alias("feature"), F.count(feature).alias("n"), r(F.avg(feature)).alias("mean"), r(F.stddev_samp(feature)).alias("std"), r(F.min(feature).cast("double")).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), r(F.max(feature).cast("double")).alias("max"))


def grouped_describe(df: DataFrame, group: str, features: list[str], digits: int = 2) -> DataFrame:
    """A row per group and feature: count, mean, sample deviation, least, exact quartiles, most. One group-by."""
    return df.groupBy(group).agg(F.array(*[_of(f, digits) for f in features]).alias("rows")).select(group, F.inline("rows"))


def segment_profile(df: DataFrame, group: str, recency: str, frequency: str, monetary: str) -> DataFrame:
    """Median recency and frequency, total and rounded mean money, size."""
    return df.groupBy(group).agg(F.round(F.median(recency), 6).alias("median_recency"), F.round(F.median(frequency), 6).alias("median_frequency"), F.round(F.sum(monetary), 4).alias("total_monetary"), F.count("*").alias("size"), F.round(F.sum(monetary) / F.count("*"), 0).alias("monetary_per_member"))


def relative_importance(df: DataFrame, group: str, features: list[str], digits: int = 6) -> DataFrame:
    """Mean of the group / mean of all - 1. Sums and counts of the groups give both, so the rows are read once."""
    sums = df.groupBy(group).agg(*[F.sum(f).alias(f"_s_{f}") for f in features], *[F.count(f).alias(f"_n_{f}") for f in features])
    total = sums.agg(*[(F.sum(f"_s_{f}") / F.sum(f"_n_{f}")).alias(f"_m_{f}") for f in features])
    both = sums.crossJoin(F.broadcast(total))
    return both.select(group, *[F.round(F.col(f"_s_{f}") / F.col(f"_n_{f}") / F.col(f"_m_{f}") - 1, digits).alias(f) for f in features])


def boxes(df: DataFrame, group: str, feature: str) -> DataFrame:
    """The figures of a box plot, a row per group: exact quartiles, whiskers at the outermost values within 1.5 times their distance, and
    how many values lie beyond."""
    quartiles = df.groupBy(group).agg(*[F.percentile(feature, F.lit(q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col(feature).between(F.col("q1") - reach, F.col("q3") + reach)
    both = df.select(group, feature).join(F.broadcast(quartiles), group)  # a row per cluster
    return both.groupBy(group).agg(F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.min(F.when(near, F.col(feature))).alias("low"), F.max(F.when(near, F.col(feature))).alias("high"), F.count_if(~near).alias("n_outliers"))
