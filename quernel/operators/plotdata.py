"""Frames behind the plots: bars, pairs of features by cluster, elbow lines. Images are left to whatever draws them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.stats import histogram


def bars(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """(label, height): a bar for each bucket of a histogram."""
    return histogram(df, column, buckets).select(F.concat(F.round("lo", 2), F.lit(" - "), F.round("hi", 2)).alias("label"), F.col("n").alias("height"))


def pairs(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """(x_name, y_name, x, y, cluster): the points of a scatter plot for each pair of features."""
    rows = F.array(*[F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(features, 2)])
    return df.select(F.col(cluster).alias("cluster"), F.inline(rows)).select("x_name", "y_name", "x", "y", "cluster")


def elbow_line(elbow: DataFrame) -> DataFrame:
    """(x, y) of the elbow plot, in order of k; a row for each k that was tried."""
    return elbow.select(F.col("k").cast("double").alias("x"), F.col("wssse").alias("y")).orderBy("x")
