"""Scaling, imputation, moments and histograms over whole frames.

Statistics of a frame are one row; they join as a broadcast of one row and never pass the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Puts the one row of a global aggregate beside every row."""
    return df.crossJoin(F.broadcast(row))


def std_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """x / sample standard deviation, not centred; a column without spread becomes 0."""
    row = df.agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in columns])
    scaled = with_row(df, row).withColumns({c: F.when(F.col(f"_sd_{c}") != 0, F.col(c) / F.col(f"_sd_{c}")).when(F.col(c).isNotNull(), 0.0) for c in columns})
    return scaled.drop(*[f"_sd_{c}" for c in columns])


def z_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centred, divided by the population standard deviation; a column without spread becomes 0."""
    row = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns])
    scaled = with_row(df, row).withColumns({c: F.when(F.col(f"_sd_{c}") != 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_sd_{c}")).when(F.col(c).isNotNull(), 0.0) for c in columns})
    return scaled.drop(*[f"_{k}_{c}" for c in columns for k in ("m", "sd")])


def log_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln(x + 1); null where x is -1 or less."""
    return df.withColumns({c: F.when(F.col(c) > -1, F.log1p(F.col(c).cast("double"))) for c in columns})


def log_scale_sql(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same, as a generated SQL statement over the frame."""
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    logs = [f"CASE WHEN `{c}` > -1 THEN ln(CAST(`{c}` AS DOUBLE) + 1) END AS `{c}`" for c in columns]
    return df.sparkSession.sql(f"SELECT {', '.join(kept + logs)} FROM {{rows}}", rows=df)


def impute_mean(df: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    """Nulls become the column's mean, rounded if asked."""
    row = df.agg(*[(F.avg(c) if digits is None else F.round(F.avg(c), digits)).alias(f"_m_{c}") for c in columns])
    return with_row(df, row).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def inliers(df: DataFrame, columns: list[str], bound: float = 3.0) -> DataFrame:
    """Rows whose every z-score is below the bound."""
    row = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns])
    near = F.lit(True)
    for c in columns:
        near = near & (F.abs(F.col(c) - F.col(f"_m_{c}")) < bound * F.col(f"_sd_{c}"))
    return with_row(df, row).where(near).drop(*[f"_{k}_{c}" for c in columns for k in ("m", "sd")])


def describe(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """A row per column: count, mean, sample deviation, least, quartiles, most. One pass for all columns."""

    def of(c: str) -> Column:
        r = lambda x: F.round(x, digits)
        q = lambda p: r(F.percentile(c, F.lit(p)))
        return F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), r(F.avg(c)).alias("mean"), r(F.stddev_samp(c)).alias("std"), r(F.min(c).cast("double")).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), r(F.max(c).cast("double")).alias("max"))

    return df.agg(F.array(*[of(c) for c in columns]).alias("rows")).select(F.inline("rows"))


def moments(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Mean, population deviation, and skewness and kurtosis with the corrections for sample size."""

    def of(c: str) -> Column:
        n = F.count(c).cast("double")
        skew = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
        r = lambda x: F.round(x, digits)
        return F.struct(F.lit(c).alias("feature"), r(F.avg(c)).alias("mu"), r(F.stddev_pop(c)).alias("sigma"), r(skew).alias("skewness"), r(kurt).alias("kurtosis"))

    return df.agg(F.array(*[of(c) for c in columns]).alias("rows")).select(F.inline("rows"))


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket, lo, hi, n): buckets of even width from the least to the largest value, the last one closed, empty ones
    with 0. Without spread there is one bucket."""
    if buckets < 1:
        raise ValueError("a histogram needs a bucket")
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    row = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null").select("a", "b", F.when(F.col("a") == F.col("b"), 1).otherwise(buckets).alias("k"), F.when(F.col("a") == F.col("b"), 1.0).otherwise((F.col("b") - F.col("a")) / buckets).alias("w"))
    bucket = F.least(F.floor((F.col("v") - F.col("a")) / F.col("w")), F.col("k") - 1).cast("int")
    counts = with_row(values, row).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    edges = row.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bucket"))
    return edges.join(counts, "bucket", "left").select("bucket", (F.col("a") + F.col("bucket") * F.col("w")).alias("lo"), F.when(F.col("bucket") == F.col("k") - 1, F.col("b")).otherwise(F.col("a") + (F.col("bucket") + 1) * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, by a rational approximation in t = sqrt(-2 ln p); error below 4.5e-4."""
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(tail))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


def probability_line(df: DataFrame, column: str, position: str, weight: str) -> DataFrame:
    """(slope, intercept, r): the line through a probability plot, values against normal quantiles of their positions."""
    x, y, n = normal_quantile(F.col(position)), F.col(column).cast("double"), F.col(weight).cast("double")
    sums = df.select(x.alias("x"), y.alias("y"), n.alias("n")).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * e).alias(a) for a, e in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")), ("yy", F.col("y") * F.col("y")))])
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("n") for a, b, c in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
    sums = sums.select("n", "x", "y", sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"))
    slope = F.try_divide("sxy", "sxx")
    return sums.select(slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("n")).alias("intercept"), F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("r"))


def density(df: DataFrame, column: str, places: int = 32) -> DataFrame:
    """(place, density): a Gaussian kernel estimate at evenly spaced places from the least to the largest value; the width follows Scott's
    rule. A task sums what its own rows add to each place."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    row = values.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"), (F.stddev_samp("v") * F.pow(F.count("*"), F.lit(-0.2))).alias("w")).where("w > 0")
    at = F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (places - 1)
    each = with_row(values, row).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).withColumn("at", at)
    z = (F.col("at") - F.col("v")) / F.col("w")
    return each.groupBy("i").agg(F.first("at").alias("place"), (F.sum(F.exp(-z * z / 2)) / (F.first("n") * F.first("w") * math.sqrt(2 * math.pi))).alias("density")).select("place", "density")
