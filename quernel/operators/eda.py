"""Exploration of orders, baskets, reorders and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.stats import with_row

#: Names of the days, Monday first.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def top(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values, ties to the smaller one: each task keeps k rows."""
    return counts(df, key).orderBy(F.desc("n"), key).limit(k)


def share(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value, and their part of all. The total is the sum of the counts."""
    found = counts(df, key)
    return with_row(found, found.agg(F.sum("n").alias("_t"))).select(key, "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def null_percent(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 6).alias("null_percent")) for c in columns]).alias("rows"))
    return row.select(F.inline("rows"))


def profile(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_null_keys"))


def mean_by(df: DataFrame, value: str, *keys: str, name: str = "ratio") -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias(name))


def pivoted(df: DataFrame, row: str, column: str, values: list, agg: Column, prefix: str) -> DataFrame:
    """A matrix of an aggregate; columns are named prefix + value, and the values are given, so that no extra job finds them."""
    found = df.groupBy(row).pivot(column, values).agg(agg)
    return found.select(row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def calendar(df: DataFrame, time: str, unit: str) -> DataFrame:
    """Every bin from the first time to the last."""
    row = df.agg(F.min(F.date_trunc(unit, time)).alias("a"), F.max(F.date_trunc(unit, time)).alias("b")).where("a is not null")
    return row.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("bin")).select(F.to_date("bin").alias("bin"))


def resample(df: DataFrame, time: str, unit: str, **aggs: Column) -> DataFrame:
    """Aggregates by day or month; bins without rows are there with 0."""
    found = df.groupBy(F.date_trunc(unit, time).cast("date").alias("bin")).agg(*[a.alias(n) for n, a in aggs.items()])
    return calendar(df, time, unit).join(found, "bin", "left").fillna(0, list(aggs))


def time_parts(df: DataFrame, time: str) -> DataFrame:
    """Adds date, time of day, hour, ISO week, `week_n`, and the weekday's name."""
    names = F.array(*map(F.lit, DAYS))
    return df.withColumns({"date": F.to_date(time), "time": F.date_format(time, "HH:mm:ss"), "hour": F.hour(time), "week": F.concat(F.lit("week_"), F.weekofyear(time).cast("string")), "weekday": F.get(names, F.weekday(time))})


def split_zone(df: DataFrame, column: str) -> DataFrame:
    """`2019-10-01 00:00:00 UTC` to the time and the zone after its last space."""
    return df.withColumns({"zone": F.substring_index(column, " ", -1), "local_time": F.regexp_replace(column, r" [^ ]*$", "")})


def order_has_basket(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """How many orders have lines, and how many have none."""
    having = lines.select("order_id").distinct().withColumn("_has", F.lit(True))
    return orders.join(having, "order_id", "left").groupBy(F.coalesce("_has", F.lit(False)).alias("has_basket")).agg(F.count("*").alias("n"))


def no_reorder_share(lines: DataFrame) -> DataFrame:
    """Orders with and without a reordered product: sums clipped at 1, and their parts of all orders."""
    return share(lines.groupBy("order_id").agg(F.least(F.sum("reordered"), F.lit(1)).alias("any_reordered")), "any_reordered")


def with_dimensions(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their product's names. The join kind is the optimiser's: products aren't bounded."""
    return lines.join(products, "product_id", "left")
