"""Writers. All go through Spark, so that a path may lie in any store that Spark writes to."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With `single`, one file: for results that one task can hold, such as summaries."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_clusters(df: DataFrame, path: str, features: list[str], cluster: str = "cluster", single: bool = False) -> None:
    """Features, then the cluster as the column `Cluster`."""
    missing = {*features, cluster} - set(df.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)}")
    write_csv(df.select(*features, df[cluster].alias("Cluster")), path, single)


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(df[column].cast("string").alias("value")).write.mode("overwrite").text(path)


def write_histogram(df: DataFrame, path: str) -> None:
    """lo, hi, n without a header."""
    df.select("lo", "hi", "n").write.mode("overwrite").csv(path)


def debug_dump(df: DataFrame, path: str | None, name: str) -> DataFrame:
    """Writes a stage's frame below `path`, if one is given, and hands the frame on."""
    if path:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    return df
