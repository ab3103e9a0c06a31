"""Adapters from the order, line, part and event tables to the logical datasets of the feature pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines of a shop: one row per line, not yet cleaned."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return joined.select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("invoice"), F.col("l_partkey").alias("stock_code"), F.col("l_returnflag").alias("description"), F.col("o_orderpriority").alias("country"),
        F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("o_orderdate").alias("invoice_date"),
    )


def basket_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers with a running number, the gap to the order before, and the split: a user's last order is `train`."""
    orders = table(spark, sf_dir, "orders")
    own = Window.partitionBy("user_id").orderBy("day", "order_id")
    found = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"))
    return found.select(
        "order_id", "user_id", F.when(F.lead("order_id").over(own).isNull(), "train").otherwise("prior").alias("eval_set"), F.row_number().over(own).cast("bigint").alias("order_number"),
        (F.dayofweek("day") - 1).cast("bigint").alias("order_dow"), F.pmod("order_id", F.lit(24)).cast("bigint").alias("order_hour_of_day"), F.date_diff("day", F.lag("day").over(own)).cast("double").alias("days_since_prior_order"),
    )


def basket_lines(spark: SparkSession, sf_dir: str, reordered: bool = True) -> DataFrame:
    """Order lines; `reordered` says whether the user had the product in an earlier order, which takes a second join."""
    orders = basket_orders(spark, sf_dir).select("order_id", "user_id", "order_number", "eval_set")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").cast("bigint").alias("add_to_cart_order"))
    joined = lines.join(orders, "order_id")
    if not reordered:
        return joined.select("order_id", "product_id", "add_to_cart_order", "eval_set")
    first = joined.groupBy("user_id", "product_id").agg(F.min("order_number").alias("first_number"))
    return joined.join(first, ["user_id", "product_id"]).select("order_id", "product_id", "add_to_cart_order", "eval_set", (F.col("order_number") > F.col("first_number")).cast("bigint").alias("reordered"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("aisle"), F.col("p_brand").alias("department"))


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click stream."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_time"), "event_type", F.col("value").alias("price"), "user_id", "props")
