"""File readers: CSV with explicit types, point files, white-space text, monthly parts, and a generator of test points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Rows that don't fit the schema are dropped; without a schema every column is a string."""
    reader = spark.read.option("header", header).option("mode", "DROPMALFORMED").option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_points(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Numeric columns as doubles, and `id`. A row with a cell that is no number is left out; a line that repeats the
    header's text is data like any other, and so is left out for that reason only."""
    rows = read_csv(spark, path, header=header)
    typed = rows.select(F.monotonically_increasing_id().alias("id"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in rows.columns])
    return typed.dropna()


def read_clusters(spark: SparkSession, path: str, cluster: str = "cluster") -> tuple[DataFrame, list[str]]:
    """A clustering result as `write_clusters` leaves it: the features as doubles and the cluster as a number; and the features' names."""
    rows = read_csv(spark, path)
    features = [c for c in rows.columns if c != "Cluster"]
    return rows.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in features], F.col("Cluster").cast("int").alias(cluster)), features


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated text to string columns col0, col1, ...; the first line says how many."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).where("v[0] != ''")
    first = lines.first()
    width = len(first["v"]) if first else 0
    return lines.select(*[F.get("v", F.lit(i)).alias(f"col{i}") for i in range(width)])


def text_to_csv(spark: SparkSession, source: str, target: str) -> None:
    spark.read.text(source).select(F.concat_ws(",", F.split(F.trim("value"), r"\s+")).alias("value")).write.text(target)


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, by column name; duplicates stay."""
    if not parts:
        raise ValueError("give one part at least")
    return reduce(DataFrame.unionByName, parts)


def monthly(df: DataFrame, time: str = "event_time") -> DataFrame:
    """Adds the month that a file of the event log would be named by."""
    return df.withColumn("month", F.date_format(time, "yyyy-MMM"))


def preclean(df: DataFrame, path: str, drop: tuple[str, ...] = ("props",), time: str = "event_time") -> None:
    """Purchases only, without the columns that nobody needs, as one folder per month."""
    monthly(df.where(F.col("event_type") == "purchase").drop(*drop), time).write.partitionBy("month").parquet(path)


def blobs(spark: SparkSession, n: int = 100_000, features: int = 2, k: int = 4, distance: float = 80.0, low: float = -100.0, high: float = 100.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(points, centres): k uniform centres, and points uniform within distance / 2 of one of them on every axis."""
    if features < 2:
        raise ValueError("points need two features at least")
    centres = spark.range(k).select(F.col("id").cast("int").alias("cluster"), *[(F.rand(seed + i) * (high - low) + low).alias(f"c{i}") for i in range(features)])
    centres = spark.createDataFrame(centres.collect(), centres.schema)  # k rows, fixed
    points = spark.range(n).withColumn("cluster", F.floor(F.rand(seed - 1) * k).cast("int")).join(F.broadcast(centres), "cluster")
    return points.select("id", *[(F.col(f"c{i}") + (F.rand(seed + 100 + i) - 0.5) * distance).alias(f"Col{i}") for i in range(features)]), centres
