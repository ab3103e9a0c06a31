"""The registered queries: each wires table adapters to operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import stats
from quernel.functions.ranks import running_sum
from quernel.operators import dbscan, eda, epsjoin, features, kmeans, summary
from quernel.plans.lineage import scratch, stored
from quernel.sources import files, sinks, tables
from quernel.sources.files import monthly, union_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Features of the clustering queries, and their parameters.
RFM = ["recency", "frequency", "monetary"]
K, TOL, MAX_ITER, ELBOW = 4, 1e-4, 250, range(2, 11)
EPS, MIN_POINTS, PAIR_EPS, SHIFT = 0.3, 5, 0.1, 0.15
BUCKETS = 16


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# retail


def _retail(spark: SparkSession, d: str) -> DataFrame:
    return features.retail_rfm(tables.retail_lines(spark, d))


@query
def load_profile(spark, d):
    return eda.profile(tables.retail_lines(spark, d), "customer_id")


@query
def null_customer_count(spark, d):
    return tables.retail_lines(spark, d).agg(F.count_if(F.col("customer_id").isNull()).alias("n_null"))


@query
def retail_amount(spark, d):
    lines = tables.retail_lines(spark, d)
    return lines.select("invoice", "line", "stock_code", F.round(F.col("price").cast("double") * F.col("quantity").cast("double"), 4).alias("amount"))


@query
def retail_clean(spark, d):
    clean = features.retail_clean(tables.retail_lines(spark, d))
    return clean.select("customer_id", "invoice", "quantity", "price", features.seconds("invoice_date").alias("invoice_seconds"), F.round("amount", 4).alias("amount"))


@query
def retail_reference_date(spark, d):
    return features.reference_date(features.retail_clean(tables.retail_lines(spark, d)), "invoice_date").select(features.seconds("reference").alias("reference_seconds"))


@query
def retail_recency(spark, d):
    clean = features.days_before(features.retail_clean(tables.retail_lines(spark, d)), "invoice_date")
    return clean.select("customer_id", "invoice", F.round("days", 6).alias("days")).distinct()


@query
def retail_recency_monetary(spark, d):
    clean = features.days_before(features.retail_clean(tables.retail_lines(spark, d)), "invoice_date")
    return clean.groupBy("customer_id").agg(F.round(F.min("days"), 6).alias("recency"), F.round(F.sum("amount"), 4).alias("monetary"))


@query
def retail_frequency(spark, d):
    clean = features.retail_clean(tables.retail_lines(spark, d))
    return clean.groupBy("customer_id", "invoice").count().groupBy("customer_id").agg(F.count("*").alias("frequency"))


@query
def retail_rfm(spark, d):
    return _retail(spark, d)


@query
def retail_rfm_days(spark, d):
    return features.retail_rfm(tables.retail_lines(spark, d), whole=True)


@query
def retail_scaled(spark, d):
    return rounded(stats.std_scale(_retail(spark, d), RFM), RFM)


@query
def retail_log(spark, d):
    return rounded(stats.log_scale_sql(_retail(spark, d), RFM), RFM)


@query
def retail_log_scaled(spark, d):
    return rounded(stats.std_scale(stats.log_scale(_retail(spark, d), RFM), RFM), RFM)


@query
def retail_zscore(spark, d):
    return rounded(stats.z_scale(_retail(spark, d), RFM), RFM)


@query
def rfm_zscore_inliers(spark, d):
    return stats.inliers(_retail(spark, d), RFM)


@query
def rfm_describe(spark, d):
    return stats.describe(_retail(spark, d), RFM, 4)


@query
def rfm_moments(spark, d):
    return stats.moments(_retail(spark, d), RFM)


@query
def rfm_qq_ranks(spark, d):
    """Plotting positions of the ordered sample, a row for each value."""
    values = _retail(spark, d).groupBy(F.col("recency").alias("value")).agg(F.count("*").alias("n"))
    below = running_sum(values, "value", "n", "below")
    ranks = stats.with_row(below, below.agg(F.sum("n").alias("t")))
    return ranks.select("value", "n", F.round((F.col("below") + (F.col("n") + 1) / 2 - 0.5) / F.col("t"), 6).alias("position"))


@query
def rfm_qq_line(spark, d):
    """The fitted line of the probability plot, and how well it fits."""
    return rounded(stats.probability_line(rfm_qq_ranks(spark, d), "value", "position", "n"), ["slope", "intercept", "r"], 4)


@query
def rfm_density(spark, d):
    return rounded(stats.density(stored(_retail(spark, d), "rfm"), "recency"), ["place", "density"])


@query
def rfm_hist25(spark, d):
    return rounded(stats.histogram(_retail(spark, d), "monetary", 25), ["lo", "hi"], 4)


# files


@query
def points_file(spark, d):
    """Features as a CSV file with a header, read back as points."""
    path = scratch(spark, "points")
    sinks.write_csv(_retail(spark, d).select(*RFM), path)
    return files.read_points(spark, path).select(*RFM)


@query
def text_columns_file(spark, d):
    """White-space separated text, read as columns."""
    path = scratch(spark, "text")
    sinks.write_lines(tables.table(spark, d, "nation").select(F.concat(F.lit(" "), F.col("n_nationkey"), F.lit("   "), F.col("n_regionkey")).alias("line")), path, "line")
    return files.read_text_columns(spark, path)


@query
def text_as_csv_file(spark, d):
    """The same text, turned into CSV and read without a header."""
    text, csv = scratch(spark, "text"), scratch(spark, "csv")
    sinks.write_lines(tables.table(spark, d, "nation").select(F.concat_ws("  ", "n_nationkey", "n_regionkey").alias("line")), text, "line")
    files.text_to_csv(spark, text, csv)
    return files.read_csv(spark, csv, "nation int, region int", header=False)


@query
def month_files(spark, d):
    """Purchases as a folder per month, read back as one table."""
    path = scratch(spark, "months")
    files.preclean(_events(spark, d), path)
    return spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("sales"))


@query
def histogram_file(spark, d):
    path = scratch(spark, "histogram")
    sinks.write_histogram(rfm_hist25(spark, d), path)
    return files.read_csv(spark, path, "lo double, hi double, n long", header=False)


# events


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables.shop_events(spark, d)


@query
def events_union_months(spark, d):
    events = monthly(_events(spark, d))
    parts = [events.where((F.dayofmonth("event_time") <= 15)), events.where(F.dayofmonth("event_time") > 15)]
    return union_parts(parts).groupBy("month", "event_type").agg(F.count("*").alias("n"))


@query
def purchase_events(spark, d):
    return _events(spark, d).where(F.col("event_type").contains("purchase")).select("event_id", "user_id", F.round("price", 4).alias("price"), F.date_format("event_time", "MMM").alias("month"))


@query
def purchase_dedup(spark, d):
    return features.events_purchases(_events(spark, d)).select("event_id", "user_id", F.round("price", 4).alias("price"))


@query
def event_time_parts(spark, d):
    stamped = _events(spark, d).withColumn("stamp", F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
    return eda.time_parts(eda.split_zone(stamped, "stamp"), "event_time").select("event_id", "local_time", "zone", F.date_format("date", "yyyy-MM-dd").alias("date"), "time", "hour", "week", "weekday")


@query
def events_rfm(spark, d):
    return rounded(features.events_rfm(_events(spark, d)), ["recency"])


@query
def events_rfm_days(spark, d):
    return features.events_rfm(_events(spark, d), whole=True)


@query
def events_scaled(spark, d):
    return rounded(stats.std_scale(features.events_rfm(_events(spark, d)), RFM), RFM)


@query
def events_log_scaled(spark, d):
    return rounded(stats.std_scale(stats.log_scale(features.events_rfm(_events(spark, d)), RFM), RFM), RFM)


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", F.date_format("bin", "yyyy-MM-dd"))


@query
def daily_customers(spark, d):
    return _day(eda.resample(features.events_purchases(_events(spark, d)), "event_time", "DAY", n_users=F.count_distinct("user_id")))


@query
def monthly_sales(spark, d):
    return _day(eda.resample(features.events_purchases(_events(spark, d)), "event_time", "MONTH", sales_millions=F.round(F.sum("price") / 1000000, 6))).withColumn("series", F.lit("total sales"))


@query
def daily_spend_per_customer(spark, d):
    bought = features.events_purchases(_events(spark, d))
    daily = eda.resample(bought, "event_time", "DAY", sales=F.sum("price"), users=F.count_distinct("user_id"))
    return _day(daily).select("bin", F.round(F.try_divide("sales", "users"), 6).alias("spend_per_customer"))


# baskets


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return features.basket_typed(tables.basket_orders(spark, d))


def _per_order(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.basket_lines(spark, d, reordered=False)
    return features.products_per_order(lines.where("eval_set = 'prior'"), lines.where("eval_set = 'train'"))


@query
def basket_typed(spark, d):
    return _orders(spark, d)


@query
def basket_flags(spark, d):
    return features.peak_flags(_orders(spark, d)).select("order_id", "on_peak_day", "on_peak_time")


@query
def basket_impute(spark, d):
    return rounded(stats.impute_mean(_orders(spark, d), ["days_since_prior_order"]).select("order_id", "days_since_prior_order"), ["days_since_prior_order"])


@query
def basket_impute_rounded(spark, d):
    return stats.impute_mean(_orders(spark, d), ["days_since_prior_order"], 0).select("order_id", "days_since_prior_order")


@query
def basket_recency(spark, d):
    return features.basket_recency(_orders(spark, d)).select("user_id", "recency")


@query
def products_per_order(spark, d):
    return _per_order(spark, d)


@query
def basket_monetary(spark, d):
    return features.basket_monetary(_orders(spark, d), _per_order(spark, d))


@query
def basket_monetary_left(spark, d):
    return features.basket_monetary(_orders(spark, d), _per_order(spark, d), left=True)


@query
def basket_rfm(spark, d):
    return features.basket_rfm(_orders(spark, d), _per_order(spark, d))


@query
def basket_scaled(spark, d):
    return rounded(stats.std_scale(features.basket_rfm(_orders(spark, d), _per_order(spark, d)), RFM), RFM)


@query
def basket_log_scaled(spark, d):
    return rounded(stats.std_scale(stats.log_scale(features.basket_rfm(_orders(spark, d), _per_order(spark, d)), RFM), RFM), RFM)


@query
def basket_six_features(spark, d):
    return features.basket_six(_orders(spark, d), _per_order(spark, d))


@query
def basket_six_features_outer(spark, d):
    return features.basket_six_outer(_orders(spark, d), _per_order(spark, d))


@query
def basket_hour_median(spark, d):
    return _orders(spark, d).groupBy("user_id").agg(F.round(F.median("order_hour_of_day"), 0).alias("median_hour"))


@query
def split_overlap(spark, d):
    orders = tables.basket_orders(spark, d)
    return orders.where("eval_set = 'prior'").select("order_id").join(orders.where("eval_set = 'train'").select("order_id"), "order_id").agg(F.count("*").alias("n_overlap"))


@query
def semi_join_keys(spark, d):
    return tables.basket_orders(spark, d).select("order_id", "user_id").join(tables.basket_lines(spark, d).where("reordered = 1"), "order_id", "left_semi")


@query
def order_has_basket(spark, d):
    return eda.order_has_basket(tables.basket_orders(spark, d), tables.basket_lines(spark, d, reordered=False))


@query
def eval_set_counts(spark, d):
    return eda.counts(tables.basket_orders(spark, d), "eval_set")


@query
def users_per_split(spark, d):
    return tables.basket_orders(spark, d).groupBy("eval_set").agg(F.count_distinct("user_id").alias("n_users"))


@query
def orders_per_customer(spark, d):
    return eda.counts(tables.basket_orders(spark, d), "user_id").orderBy("n", "user_id")


@query
def orders_per_customer_stats(spark, d):
    return eda.counts(tables.basket_orders(spark, d), "user_id").agg(F.round(F.avg("n"), 6).alias("mean_orders"), F.median("n").alias("median_orders"))


@query
def max_order_number_dist(spark, d):
    return tables.basket_orders(spark, d).groupBy("user_id").agg(F.max("order_number").alias("max_order_number")).groupBy("max_order_number").agg(F.count("*").alias("n"))


@query
def basket_size_dist(spark, d):
    return eda.counts(_per_order(spark, d), "n_products")


@query
def null_percent(spark, d):
    return eda.null_percent(tables.basket_orders(spark, d), ["order_id", "user_id", "order_number", "days_since_prior_order"])


def _lines(spark: SparkSession, d: str, reordered: bool = True) -> DataFrame:
    return eda.with_dimensions(tables.basket_lines(spark, d, reordered), tables.products(spark, d))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return tables.basket_lines(spark, d).drop("eval_set").join(tables.basket_orders(spark, d), "order_id", "left")


@query
def line_product_dims(spark, d):
    return _lines(spark, d, False).groupBy("aisle", "department").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("n_products"))


@query
def reorder_ratio(spark, d):
    return tables.basket_lines(spark, d).groupBy("eval_set").agg(F.round(F.sum("reordered") / F.count("*"), 6).alias("ratio"))


@query
def no_reorder_share(spark, d):
    return eda.no_reorder_share(tables.basket_lines(spark, d))


@query
def department_share(spark, d):
    return eda.share(_lines(spark, d, False), "department")


@query
def reorder_by_department(spark, d):
    return eda.mean_by(_lines(spark, d), "reordered", "department")


@query
def reorder_by_dept_aisle(spark, d):
    return eda.mean_by(_lines(spark, d), "reordered", "department", "aisle")


@query
def reorder_by_cart_position(spark, d):
    clipped = tables.basket_lines(spark, d).withColumn("position", F.least("add_to_cart_order", F.lit(70)))
    return eda.mean_by(clipped, "reordered", "position")


@query
def reorder_by_dow(spark, d):
    return eda.mean_by(_timed(spark, d), "reordered", "order_dow")


@query
def reorder_by_hour(spark, d):
    return eda.mean_by(_timed(spark, d), "reordered", "order_hour_of_day")


@query
def orders_dow_hour_pivot(spark, d):
    return eda.pivoted(tables.basket_orders(spark, d), "order_dow", "order_hour_of_day", list(range(24)), F.count(F.lit(1)), "h").fillna(0)


@query
def reorder_dow_hour_pivot(spark, d):
    return eda.pivoted(_timed(spark, d), "order_dow", "order_hour_of_day", list(range(24)), F.round(F.avg("reordered"), 6), "h")


@query
def top20_products(spark, d):
    """Only products with lines can be among the top: names join after the count."""
    best = eda.top(tables.basket_lines(spark, d, reordered=False), "product_id", 20)
    return best.join(tables.products(spark, d).select("product_id", "product_name"), "product_id", "left")


@query
def top20_aisles(spark, d):
    return eda.top(_lines(spark, d, False), "aisle", 20)


# clusters


def points(spark: SparkSession, d: str) -> DataFrame:
    """Customers in log-scaled, standardised recency, frequency and monetary value."""
    scaled = stats.std_scale(stats.log_scale(_retail(spark, d), RFM), RFM)
    return rounded(scaled.withColumnRenamed("customer_id", "id"), RFM, kmeans.DIGITS)


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, kmeans.KMeansModel]:
    """The points and their centres, which have come to rest."""
    at = stored(points(spark, d), "points")
    return at, kmeans.fit(at, RFM, K, TOL, MAX_ITER)


@query
def bounding_box(spark, d):
    at = points(spark, d)
    return at.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.min(f), 6).alias("lo"), F.round(F.max(f), 6).alias("hi")) for f in RFM]).alias("r")).select(F.inline("r"))


@query
def kmeans_init(spark, d):
    start = kmeans.KMeansModel(RFM, kmeans.initial(points(spark, d), RFM, K)).frame(spark)
    return rounded(start, RFM)


@query
def kmeans_centroids(spark, d):
    return rounded(_model(spark, d)[1].frame(spark), RFM)


@query
def kmeans_assign(spark, d):
    at, model = _model(spark, d)
    return model.assign(at).select("id", "cluster")


@query
def kmeans_shift(spark, d):
    """The mean move of the centres in the last round."""
    return spark.createDataFrame([(_model(spark, d)[1].shift,)], "shift double").select(F.round("shift", 6).alias("shift"))


@query
def kmeans_wssse(spark, d):
    return rounded(kmeans.wssse(*_model(spark, d)), ["wssse"], 4)


@query
def kmeans_elbow(spark, d):
    return rounded(kmeans.elbow(points(spark, d), RFM, ELBOW, TOL, MAX_ITER), ["wssse"], 4)


@query
def cluster_summary(spark, d):
    at, model = _model(spark, d)
    return summary.grouped_describe(model.assign(at), "cluster", RFM)


@query
def cluster_boxes(spark, d):
    at, model = _model(spark, d)
    return rounded(summary.boxes(model.assign(at), "cluster", "monetary"), ["q1", "median", "q3", "low", "high"])


@query
def cluster_file(spark, d):
    """Clusters are written as a file, read back as a clustering result, and described from it."""
    at, model = _model(spark, d)
    path = scratch(spark, "clusters")
    sinks.write_clusters(model.assign(at), path, RFM)
    back, names = files.read_clusters(spark, path)
    return summary.grouped_describe(back, "cluster", names)


def _named(spark: SparkSession, d: str) -> DataFrame:
    at, model = _model(spark, d)
    return model.assign(at).select(F.col("id").alias("customer_id"), "cluster").join(_retail(spark, d), "customer_id")


@query
def segment_profile(spark, d):
    return summary.segment_profile(_named(spark, d), "cluster", *RFM)


@query
def relative_importance(spark, d):
    return summary.relative_importance(_named(spark, d), "cluster", RFM)


def _library(spark, d, mode):
    model, found = kmeans.library_fit(points(spark, d), RFM, K, mode=mode)
    return found.groupBy("cluster").agg(F.count("*").alias("n"), *[F.round(F.avg(f), 6).alias(f) for f in RFM]).withColumn("cost", F.lit(round(model.summary.trainingCost, 4)))


@query
def kmeans_ml_random(spark, d):
    return _library(spark, d, "random")


@query
def kmeans_ml_parallel(spark, d):
    return _library(spark, d, "k-means||")


@query
def kmeans_elbow_ml(spark, d):
    at = points(spark, d)
    return spark.createDataFrame([(k, round(kmeans.library_fit(at, RFM, k)[0].summary.trainingCost, 4)) for k in ELBOW], "k int, cost double")


@query
def pca_projection(spark, d):
    return rounded(kmeans.project(points(spark, d), RFM).select("id", "pc1", "pc2"), ["pc1", "pc2"])


@query
def eps_pairs(spark, d):
    return rounded(epsjoin.eps_pairs(stored(points(spark, d), "points"), RFM, PAIR_EPS), ["dist"])


@query
def dbscan_neighbor_counts(spark, d):
    return epsjoin.neighbour_counts(stored(points(spark, d), "points"), RFM, EPS)


def _dbscan(spark: SparkSession, d: str, **more) -> dbscan.DbscanModel:
    return dbscan.fit(points(spark, d), RFM, dbscan.DbscanParams(EPS, MIN_POINTS, **more))


@query
def dbscan_labels(spark, d):
    return _dbscan(spark, d).labelled.select("id", "cluster")


@query
def dbscan_border_as_noise(spark, d):
    return _dbscan(spark, d, border_as_noise=True).labelled.select("id", "cluster")


@query
def dbscan_num_clusters(spark, d):
    return _dbscan(spark, d).number_of_clusters()


@query
def dbscan_cluster_sizes(spark, d):
    return _dbscan(spark, d).sizes()


@query
def dbscan_noise_count(spark, d):
    return _dbscan(spark, d).noise().agg(F.count("*").alias("n_noise"))


@query
def dbscan_predict(spark, d):
    """The cluster of every customer moved by SHIFT along each feature."""
    at = stored(points(spark, d), "points")
    return dbscan.fit(at, RFM, dbscan.DbscanParams(EPS, MIN_POINTS)).predict(at.withColumns({f: F.col(f) + SHIFT for f in RFM}))


@query
def nn_distance(spark, d):
    return rounded(epsjoin.nearest_distance(points(spark, d), RFM), ["dist"])


@query
def nn_histogram(spark, d):
    found = stored(rounded(epsjoin.nearest_distance(points(spark, d), RFM), ["dist"], 9), "nearest")
    return rounded(stats.histogram(found, "dist", BUCKETS), ["lo", "hi"])


@query
def neighbor_histogram(spark, d):
    near = stored(epsjoin.neighbour_counts(stored(points(spark, d), "points"), RFM, EPS), "neighbours")
    return rounded(stats.histogram(near, "n", BUCKETS), ["lo", "hi"])
