"""Per-customer features: recency, frequency and monetary value, for the three logical datasets.

Recency and monetary value and the number of invoices come from one two-level group-by, whose
first level combines map-side, so that a customer with very many rows is many partial sums, not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.stats import impute_mean, with_row
from quernel.plans.lineage import stored

DAY = 86400.0


def seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970; a timestamp without zone counts as UTC."""
    return F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def retail_clean(lines: DataFrame) -> DataFrame:
    """Distinct lines of known customers with a positive quantity; measures become numbers and `amount` is added."""
    kept = lines.dropDuplicates().where(F.col("customer_id").isNotNull() & (F.col("quantity").try_cast("double") > 0))
    kept = kept.drop("stock_code", "description", "country", "line")
    return kept.withColumns({"quantity": F.col("quantity").try_cast("double"), "price": F.col("price").try_cast("double"), "invoice_date": F.col("invoice_date").cast("timestamp")}).withColumn("amount", F.col("price") * F.col("quantity"))


def reference_date(df: DataFrame, time: str) -> DataFrame:
    """One row: a day after the last time."""
    return df.agg((F.max(F.col(time).cast("timestamp")) + F.expr("INTERVAL 24 HOURS")).alias("reference"))


def days_before(df: DataFrame, time: str, whole: bool = False) -> DataFrame:
    """Adds `days` between each row's time and the reference date; fractional, or whole days."""
    found = with_row(df, reference_date(df, time))
    days = F.abs(seconds(F.col(time)) - seconds(F.col("reference"))) / DAY
    return found.withColumn("days", F.floor(days).cast("double") if whole else days).drop("reference")


def retail_rfm(lines: DataFrame, whole: bool = False) -> DataFrame:
    """customer_id, recency (days before the reference date), frequency (invoices), monetary. The customers' sums are stored, and
    the reference date is the last of their dates: left to one plan, the lines would be read and joined twice."""
    clean = retail_clean(lines)
    invoices = clean.groupBy("customer_id", "invoice").agg(F.max("invoice_date").alias("last"), F.sum("amount").alias("amount"))
    people = stored(invoices.groupBy("customer_id").agg(F.max("last").alias("last"), F.count("*").alias("frequency"), F.sum("amount").alias("monetary")), "retail-people")
    return days_before(people, "last", whole).select("customer_id", F.col("days").alias("recency"), "frequency", F.round("monetary", 4).alias("monetary"))


def events_purchases(events: DataFrame, least_exclusive: float | None = 0.0) -> DataFrame:
    """Distinct purchase events of known users with a price above the bound, or at least 0 where the bound is None."""
    price = F.col("price").try_cast("double")
    bought = events.where(F.col("event_type").contains("purchase")).dropDuplicates().where(F.col("user_id").isNotNull())
    bought = bought.where(price >= 0 if least_exclusive is None else price > least_exclusive)
    return bought.select("event_id", F.col("event_time").cast("timestamp").alias("event_time"), price.alias("price"), "user_id")


def events_rfm(events: DataFrame, whole: bool = False) -> DataFrame:
    bought = events_purchases(events, None if whole else 0.0)
    people = stored(bought.groupBy("user_id").agg(F.max("event_time").alias("last"), F.count("*").alias("frequency"), F.sum("price").alias("monetary")), "event-people")
    return days_before(people, "last", whole).select("user_id", F.col("days").alias("recency"), "frequency", F.round("monetary", 4).alias("monetary"))


def basket_typed(orders: DataFrame) -> DataFrame:
    """Distinct orders of known users, numbers as doubles."""
    numbers = ["order_number", "order_dow", "order_hour_of_day", "days_since_prior_order"]
    return orders.withColumns({c: F.col(c).try_cast("double") for c in numbers}).dropDuplicates().where(F.col("user_id").isNotNull())


def products_per_order(prior: DataFrame, train: DataFrame) -> DataFrame:
    """The largest cart position of each order, over both splits."""
    return prior.unionByName(train).groupBy("order_id").agg(F.max(F.col("add_to_cart_order").cast("double")).alias("n_products"))


def basket_monetary(orders: DataFrame, per_order: DataFrame, left: bool = False) -> DataFrame:
    """Mean products per order of each user. With `left`, orders without lines count with the rounded mean."""
    joined = orders.select("order_id", "user_id").join(per_order, "order_id", "left" if left else "inner")
    joined = impute_mean(joined, ["n_products"], 0) if left else joined
    return joined.groupBy("user_id").agg(F.round(F.avg("n_products"), 6).alias("monetary"))


def basket_recency(orders: DataFrame, digits: int | None = None) -> DataFrame:
    """user_id, recency (mean gap between orders, first orders having the mean gap of all), frequency. Users' sums and counts
    give the mean of all as well, so the orders are read once."""
    gap = F.col("days_since_prior_order")
    people = stored(orders.groupBy("user_id").agg(F.sum(gap).alias("gaps"), F.count(gap).alias("n_gaps"), F.count("*").alias("frequency")), "basket-people")
    mean = F.sum("gaps") / F.nullif(F.sum("n_gaps"), F.lit(0))
    found = with_row(people, people.agg((mean if digits is None else F.round(mean, digits)).alias("mean")))
    filled = F.coalesce("gaps", F.lit(0.0)) + F.when(F.col("frequency") > F.col("n_gaps"), (F.col("frequency") - F.col("n_gaps")) * F.col("mean")).otherwise(0.0)
    return found.select("user_id", F.round(filled / F.col("frequency"), 6).alias("recency"), "frequency")


def basket_rfm(orders: DataFrame, per_order: DataFrame) -> DataFrame:
    return basket_recency(orders).join(basket_monetary(orders, per_order), "user_id")


def peak_flags(orders: DataFrame) -> DataFrame:
    """Whether an order falls on the first two days of the week, and between 10 and 16 o'clock."""
    return orders.withColumns({"on_peak_day": F.when(F.col("order_dow") <= 1, 1).otherwise(0), "on_peak_time": F.when(F.col("order_hour_of_day").between(10, 16), 1).otherwise(0)})


def basket_extra(orders: DataFrame, median: bool = False) -> DataFrame:
    """Peak-day rate, mean (or median) hour, peak-time rate: one group-by for all three."""
    hour = F.round(F.median("order_hour_of_day"), 0) if median else F.round(F.avg("order_hour_of_day"), 2)
    return peak_flags(orders).groupBy("user_id").agg(F.round(F.avg("on_peak_day"), 2).alias("avg_order_on_peak"), hour.alias("avg_order_hour_of_day"), F.round(F.avg("on_peak_time"), 2).alias("avg_peak_time_rate"))


def basket_six(orders: DataFrame, per_order: DataFrame) -> DataFrame:
    return basket_rfm(orders, per_order).join(basket_extra(orders), "user_id")


def basket_six_outer(orders: DataFrame, per_order: DataFrame) -> DataFrame:
    """The variant that keeps orders without lines, rounds imputed means, and aligns its parts by outer joins."""
    parts = [basket_recency(orders, 0), basket_monetary(orders, per_order, left=True), basket_extra(orders, median=True)]
    found = parts[0]
    for p in parts[1:]:
        found = found.join(p, "user_id", "full_outer")
    return found
