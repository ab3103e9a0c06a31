"""DuckDB SQL for the registered queries, composed from common table expressions."""

from __future__ import annotations

from .queries import BUCKETS, ELBOW, EPS, MAX_ITER, MIN_POINTS, PAIR_EPS, RFM, SHIFT, TOL, K

SQL: dict[str, str] = {}

_RAW = """raw AS (
  SELECT o_custkey AS customer_id, o_orderkey AS invoice, l_partkey AS stock_code, l_returnflag AS description, o_orderpriority AS country,
    l_linenumber AS line, l_quantity AS quantity, l_extendedprice / nullif(l_quantity, 0) AS price, o_orderdate AS invoice_date
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_CLEAN = f"""{_RAW}, clean AS (
  SELECT customer_id, invoice, quantity, price, invoice_date, price * quantity AS amount FROM (SELECT DISTINCT * FROM raw)
  WHERE customer_id IS NOT NULL AND quantity > 0),
ref AS (SELECT max(invoice_date) + INTERVAL 24 HOURS AS reference FROM clean),
dated AS (SELECT *, abs(floor(epoch(invoice_date)) - floor(epoch(reference))) / 86400.0 AS days FROM clean, ref)"""
_RFM = f"""{_CLEAN}, rfm AS (
  SELECT customer_id, min(days) AS recency, count(DISTINCT invoice) AS frequency, round(sum(amount), 4) AS monetary
  FROM dated GROUP BY customer_id)"""


def _each(template: str, sep: str = ", ", names: list[str] = RFM) -> str:
    return sep.join(template.format(c=c) for c in names)


def _std(source: str, name: str, key: str, digits: int | None = 6) -> str:
    """A table of x / sample deviation."""
    value = "CASE WHEN s_{c} <> 0 THEN {c} / s_{c} WHEN {c} IS NOT NULL THEN 0.0 END"
    shown = f"round({value}, {digits}) AS {{c}}" if digits is not None else f"{value} AS {{c}}"
    return f"{name} AS (SELECT {key}, {_each(shown)} FROM {source}, (SELECT {_each('stddev_samp({c}) AS s_{c}')} FROM {source}))"


def _log(source: str, name: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, {_each('CASE WHEN {c} > -1 THEN ln({c} + 1) END AS {c}')} FROM {source})"


SQL["load_profile"] = f"WITH {_RAW} SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_keys, count(*) FILTER (customer_id IS NULL) AS n_null_keys FROM raw"
SQL["null_customer_count"] = f"WITH {_RAW} SELECT count(*) FILTER (customer_id IS NULL) AS n_null FROM raw"
SQL["retail_amount"] = f"WITH {_RAW} SELECT invoice, line, stock_code, round(price * quantity, 4) AS amount FROM raw"
SQL["retail_clean"] = f"WITH {_CLEAN} SELECT customer_id, invoice, quantity, price, CAST(floor(epoch(invoice_date)) AS BIGINT) AS invoice_seconds, round(amount, 4) AS amount FROM clean"
SQL["retail_reference_date"] = f"WITH {_CLEAN} SELECT CAST(floor(epoch(reference)) AS BIGINT) AS reference_seconds FROM ref"
SQL["retail_recency"] = f"WITH {_CLEAN} SELECT DISTINCT customer_id, invoice, round(days, 6) AS days FROM dated"
SQL["retail_recency_monetary"] = f"WITH {_CLEAN} SELECT customer_id, round(min(days), 6) AS recency, round(sum(amount), 4) AS monetary FROM dated GROUP BY 1"
SQL["retail_frequency"] = f"WITH {_CLEAN} SELECT customer_id, count(DISTINCT invoice) AS frequency FROM clean GROUP BY 1"
SQL["retail_rfm"] = f"WITH {_RFM} SELECT * FROM rfm"
SQL["retail_rfm_days"] = f"WITH {_RFM} SELECT customer_id, floor(recency) AS recency, frequency, monetary FROM rfm"
SQL["retail_scaled"] = f"WITH {_RFM}, {_std('rfm', 'scaled', 'customer_id')} SELECT * FROM scaled"
SQL["retail_log"] = f"WITH {_RFM} SELECT customer_id, {_each('round(CASE WHEN {c} > -1 THEN ln({c} + 1) END, 6) AS {c}')} FROM rfm"
SQL["retail_log_scaled"] = f"WITH {_RFM}, {_log('rfm', 'logs', 'customer_id')}, {_std('logs', 'scaled', 'customer_id')} SELECT * FROM scaled"
SQL["retail_zscore"] = f"WITH {_RFM} SELECT customer_id, {_each('round(CASE WHEN s_{c} <> 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END, 6) AS {c}')} FROM rfm, (SELECT {_each('avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}')} FROM rfm)"
SQL["rfm_zscore_inliers"] = f"WITH {_RFM} SELECT customer_id, recency, frequency, monetary FROM rfm, (SELECT {_each('avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}')} FROM rfm) WHERE {_each('abs({c} - m_{c}) < 3 * s_{c}', ' AND ')}"
_DESCRIBE = "SELECT {g}'{{c}}' AS feature, count({{c}}) AS n, round(avg({{c}}), {d}) AS mean, round(stddev_samp({{c}}), {d}) AS std, round(CAST(min({{c}}) AS DOUBLE), {d}) AS min, round(quantile_cont({{c}}, 0.25), {d}) AS p25, round(quantile_cont({{c}}, 0.5), {d}) AS p50, round(quantile_cont({{c}}, 0.75), {d}) AS p75, round(CAST(max({{c}}) AS DOUBLE), {d}) AS max FROM {t}{by}"
SQL["rfm_describe"] = f"WITH {_RFM} " + _each(_DESCRIBE.format(g="", d=4, t="rfm", by=""), " UNION ALL ")
SQL["rfm_moments"] = f"WITH {_RFM} " + _each("SELECT '{c}' AS feature, round(avg({c}), 6) AS mu, round(stddev_pop({c}), 6) AS sigma, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM rfm", " UNION ALL ")
SQL["rfm_qq_ranks"] = f"WITH {_RFM}, v AS (SELECT recency AS value, count(*) AS n FROM rfm GROUP BY 1) SELECT value, n, round((sum(n) OVER (ORDER BY value) - n + (n + 1) / 2.0 - 0.5) / sum(n) OVER (), 6) AS position FROM v"

_Z = "(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))"
SQL["rfm_qq_line"] = f"""WITH {_RFM}, v AS (SELECT recency AS y, count(*) AS n FROM rfm GROUP BY 1),
p AS (SELECT y, n, round((sum(n) OVER (ORDER BY y) - n + (n + 1) / 2.0 - 0.5) / sum(n) OVER (), 6) AS p FROM v),
q AS (SELECT y, n, CASE WHEN p < 0.5 THEN -{_Z} ELSE {_Z} END AS x FROM (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p)),
s AS (SELECT sum(n) AS n, sum(n * x) AS x, sum(n * y) AS y, sum(n * x * x) AS xx, sum(n * x * y) AS xy, sum(n * y * y) AS yy FROM q),
c AS (SELECT n, x, y, xx - x * x / n AS sxx, xy - x * y / n AS sxy, yy - y * y / n AS syy FROM s)
SELECT round(sxy / sxx, 4) AS slope, round((y - sxy / sxx * x) / n, 4) AS intercept, round(sxy / sqrt(sxx * syy), 4) AS r FROM c"""
SQL["rfm_density"] = f"""WITH {_RFM}, r AS (SELECT min(recency) AS a, max(recency) AS b, count(*) AS n, stddev_samp(recency) * pow(count(*), -0.2) AS w FROM rfm),
g AS (SELECT a + (b - a) * i / 31 AS place, n, w FROM r, generate_series(0, 31) AS t(i))
SELECT round(g.place, 6) AS place, round(sum(exp(-((place - recency) / w) * ((place - recency) / w) / 2)) / (any_value(n) * any_value(w) * sqrt(2 * pi())), 6) AS density FROM g, rfm GROUP BY g.place"""
SQL["points_file"] = f"WITH {_RFM} SELECT recency, CAST(frequency AS DOUBLE) AS frequency, monetary FROM rfm"
SQL["text_columns_file"] = "SELECT CAST(n_nationkey AS VARCHAR) AS col0, CAST(n_regionkey AS VARCHAR) AS col1 FROM nation"
SQL["text_as_csv_file"] = "SELECT n_nationkey AS nation, n_regionkey AS region FROM nation"
SQL["month_files"] = "SELECT strftime(ts, '%Y-%b') AS month, count(*) AS n, round(sum(value), 4) AS sales FROM events WHERE event_type = 'purchase' GROUP BY 1"


def _histogram(source: str, column: str, k: int, digits: int) -> str:
    return f"""hv AS (SELECT CAST({column} AS DOUBLE) AS v FROM {source} WHERE {column} IS NOT NULL),
hr AS (SELECT min(v) AS a, max(v) AS b, CASE WHEN min(v) = max(v) THEN 1 ELSE {k} END AS k, CASE WHEN min(v) = max(v) THEN 1.0 ELSE (max(v) - min(v)) / {k} END AS w FROM hv),
hc AS (SELECT CAST(least(floor((v - a) / w), k - 1) AS INTEGER) AS bucket, count(*) AS n FROM hv, hr GROUP BY 1),
he AS (SELECT a, b, k, w, CAST(unnest(generate_series(0, k - 1)) AS INTEGER) AS bucket FROM hr)
SELECT bucket, round(a + bucket * w, {digits}) AS lo, round(CASE WHEN bucket = k - 1 THEN b ELSE a + (bucket + 1) * w END, {digits}) AS hi, coalesce(n, 0) AS n FROM he LEFT JOIN hc USING (bucket)"""


SQL["rfm_hist25"] = f"WITH {_RFM}, {_histogram('rfm', 'monetary', 25, 4)}"

SQL["histogram_file"] = f"SELECT lo, hi, n FROM ({SQL['rfm_hist25']})"
_BOUGHT = """bought AS (
  SELECT DISTINCT event_id, ts AS event_time, event_type, value AS price, user_id, props FROM events
  WHERE contains(event_type, 'purchase') AND user_id IS NOT NULL AND value > 0)"""
_ERFM = f"""{_BOUGHT}, eref AS (SELECT max(event_time) + INTERVAL 24 HOURS AS reference FROM bought),
erfm AS (SELECT user_id, abs(floor(epoch(max(event_time))) - floor(epoch(any_value(reference)))) / 86400.0 AS recency, count(*) AS frequency, round(sum(price), 4) AS monetary FROM bought, eref GROUP BY user_id)"""
SQL["events_union_months"] = "SELECT strftime(ts, '%Y-%b') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2"
SQL["purchase_events"] = "SELECT event_id, user_id, round(value, 4) AS price, strftime(ts, '%b') AS month FROM events WHERE contains(event_type, 'purchase')"
SQL["purchase_dedup"] = f"WITH {_BOUGHT} SELECT event_id, user_id, round(price, 4) AS price FROM bought"
SQL["event_time_parts"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS local_time, 'UTC' AS zone, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, CAST(hour(ts) AS INTEGER) AS hour, 'week_' || weekofyear(ts) AS week, dayname(ts) AS weekday FROM events"
SQL["events_rfm"] = f"WITH {_ERFM} SELECT user_id, round(recency, 6) AS recency, frequency, monetary FROM erfm"
SQL["events_rfm_days"] = f"WITH {_ERFM.replace('value > 0)', 'value >= 0)')} SELECT user_id, floor(recency) AS recency, frequency, monetary FROM erfm"
SQL["events_scaled"] = f"WITH {_ERFM}, {_std('erfm', 'scaled', 'user_id')} SELECT * FROM scaled"
SQL["events_log_scaled"] = f"WITH {_ERFM}, {_log('erfm', 'logs', 'user_id')}, {_std('logs', 'scaled', 'user_id')} SELECT * FROM scaled"
_DAYS = f"{_BOUGHT}, bins AS (SELECT unnest(generate_series(date_trunc('{{u}}', min(event_time)), date_trunc('{{u}}', max(event_time)), INTERVAL 1 {{u}})) AS bin FROM bought), sums AS (SELECT date_trunc('{{u}}', event_time) AS bin, sum(price) AS sales, count(DISTINCT user_id) AS users FROM bought GROUP BY 1)"
SQL["daily_customers"] = f"WITH {_DAYS.format(u='DAY')} SELECT strftime(bin, '%Y-%m-%d') AS bin, coalesce(users, 0) AS n_users FROM bins LEFT JOIN sums USING (bin)"
SQL["monthly_sales"] = f"WITH {_DAYS.format(u='MONTH')} SELECT strftime(bin, '%Y-%m-%d') AS bin, coalesce(round(sales / 1000000, 6), 0) AS sales_millions, 'total sales' AS series FROM bins LEFT JOIN sums USING (bin)"
SQL["daily_spend_per_customer"] = f"WITH {_DAYS.format(u='DAY')} SELECT strftime(bin, '%Y-%m-%d') AS bin, round(sales / users, 6) AS spend_per_customer FROM bins LEFT JOIN sums USING (bin)"

_ORDERS = """bo AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1 THEN 'train' ELSE 'prior' END AS eval_set,
    row_number() OVER w AS order_number, CAST(dayofweek(o_orderdate) AS BIGINT) AS order_dow, o_orderkey % 24 AS order_hour_of_day,
    CAST(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)) AS DOUBLE) AS days_since_prior_order
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey))"""
_TYPED = f"{_ORDERS}, ot AS (SELECT DISTINCT order_id, user_id, eval_set, CAST(order_number AS DOUBLE) AS order_number, CAST(order_dow AS DOUBLE) AS order_dow, CAST(order_hour_of_day AS DOUBLE) AS order_hour_of_day, days_since_prior_order FROM bo WHERE user_id IS NOT NULL), gap AS (SELECT avg(days_since_prior_order) AS m FROM ot)"
_LINES = f"""{_TYPED}, bj AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS add_to_cart_order, user_id, order_number, eval_set FROM lineitem JOIN bo ON l_orderkey = order_id),
bf AS (SELECT user_id, product_id, min(order_number) AS first_number FROM bj GROUP BY 1, 2),
bl AS (SELECT order_id, product_id, add_to_cart_order, eval_set, CAST(order_number > first_number AS BIGINT) AS reordered FROM bj JOIN bf USING (user_id, product_id)),
po AS (SELECT order_id, max(CAST(add_to_cart_order AS DOUBLE)) AS n_products FROM bl GROUP BY 1)"""
_BRFM = f"""{_LINES}, br AS (SELECT user_id, round(avg(coalesce(days_since_prior_order, m)), 6) AS recency, count(*) AS frequency FROM ot, gap GROUP BY 1),
bm AS (SELECT user_id, round(avg(n_products), 6) AS monetary FROM ot JOIN po USING (order_id) GROUP BY 1),
bml AS (SELECT user_id, round(avg(coalesce(n_products, mp)), 6) AS monetary FROM (SELECT user_id, n_products FROM ot LEFT JOIN po USING (order_id)), (SELECT round(avg(n_products), 0) AS mp FROM ot JOIN po USING (order_id)) GROUP BY 1),
brfm AS (SELECT user_id, recency, frequency, monetary FROM br JOIN bm USING (user_id)),
bx AS (SELECT user_id, round(avg(CASE WHEN order_dow <= 1 THEN 1 ELSE 0 END), 2) AS avg_order_on_peak, round(avg(order_hour_of_day), 2) AS mean_hour, round(median(order_hour_of_day), 0) AS median_hour, round(avg(CASE WHEN order_hour_of_day BETWEEN 10 AND 16 THEN 1 ELSE 0 END), 2) AS avg_peak_time_rate FROM ot GROUP BY 1)"""
SQL["basket_typed"] = f"WITH {_TYPED} SELECT * FROM ot"
SQL["basket_flags"] = f"WITH {_TYPED} SELECT order_id, CAST(order_dow <= 1 AS INTEGER) AS on_peak_day, CAST(order_hour_of_day BETWEEN 10 AND 16 AS INTEGER) AS on_peak_time FROM ot"
SQL["basket_impute"] = f"WITH {_TYPED} SELECT order_id, round(coalesce(days_since_prior_order, m), 6) AS days_since_prior_order FROM ot, gap"
SQL["basket_impute_rounded"] = f"WITH {_TYPED} SELECT order_id, coalesce(days_since_prior_order, round(m, 0)) AS days_since_prior_order FROM ot, gap"
SQL["basket_recency"] = f"WITH {_BRFM} SELECT user_id, recency FROM br"
SQL["products_per_order"] = f"WITH {_LINES} SELECT * FROM po"
SQL["basket_monetary"] = f"WITH {_BRFM} SELECT * FROM bm"
SQL["basket_monetary_left"] = f"WITH {_BRFM} SELECT * FROM bml"
SQL["basket_rfm"] = f"WITH {_BRFM} SELECT * FROM brfm"
SQL["basket_scaled"] = f"WITH {_BRFM}, {_std('brfm', 'scaled', 'user_id')} SELECT * FROM scaled"
SQL["basket_log_scaled"] = f"WITH {_BRFM}, {_log('brfm', 'logs', 'user_id')}, {_std('logs', 'scaled', 'user_id')} SELECT * FROM scaled"
SQL["basket_six_features"] = f"WITH {_BRFM} SELECT user_id, recency, frequency, monetary, avg_order_on_peak, mean_hour AS avg_order_hour_of_day, avg_peak_time_rate FROM brfm JOIN bx USING (user_id)"
SQL["basket_six_features_outer"] = f"WITH {_BRFM} SELECT user_id, r.recency, br.frequency, monetary, avg_order_on_peak, median_hour AS avg_order_hour_of_day, avg_peak_time_rate FROM (SELECT user_id, round(avg(coalesce(days_since_prior_order, round(m, 0))), 6) AS recency FROM ot, gap GROUP BY 1) r FULL JOIN br USING (user_id) FULL JOIN bml USING (user_id) FULL JOIN bx USING (user_id)"
SQL["basket_hour_median"] = f"WITH {_BRFM} SELECT user_id, median_hour FROM bx"
SQL["split_overlap"] = f"WITH {_ORDERS} SELECT count(*) AS n_overlap FROM bo a JOIN bo b USING (order_id) WHERE a.eval_set = 'prior' AND b.eval_set = 'train'"
SQL["semi_join_keys"] = f"WITH {_LINES} SELECT order_id, user_id FROM bo WHERE order_id IN (SELECT order_id FROM bl WHERE reordered = 1)"
SQL["order_has_basket"] = f"WITH {_LINES} SELECT order_id IN (SELECT order_id FROM bl) AS has_basket, count(*) AS n FROM bo GROUP BY 1"
SQL["eval_set_counts"] = f"WITH {_ORDERS} SELECT eval_set, count(*) AS n FROM bo GROUP BY 1"
SQL["users_per_split"] = f"WITH {_ORDERS} SELECT eval_set, count(DISTINCT user_id) AS n_users FROM bo GROUP BY 1"
SQL["orders_per_customer"] = f"WITH {_ORDERS} SELECT user_id, count(*) AS n FROM bo GROUP BY 1"
SQL["orders_per_customer_stats"] = f"WITH {_ORDERS} SELECT round(avg(n), 6) AS mean_orders, median(n) AS median_orders FROM (SELECT count(*) AS n FROM bo GROUP BY user_id)"
SQL["max_order_number_dist"] = f"WITH {_ORDERS} SELECT max_order_number, count(*) AS n FROM (SELECT max(order_number) AS max_order_number FROM bo GROUP BY user_id) GROUP BY 1"
SQL["basket_size_dist"] = f"WITH {_LINES} SELECT n_products, count(*) AS n FROM po GROUP BY 1"
SQL["null_percent"] = f"WITH {_ORDERS} " + _each("SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 6) AS null_percent FROM bo", " UNION ALL ", ["order_id", "user_id", "order_number", "days_since_prior_order"])
_DIMS = f"{_LINES}, ld AS (SELECT bl.*, p_name AS product_name, p_type AS aisle, p_brand AS department FROM bl LEFT JOIN part ON product_id = p_partkey)"
_TIMED = f"{_LINES}, lt AS (SELECT bl.order_id, reordered, order_dow, order_hour_of_day FROM bl LEFT JOIN bo USING (order_id))"
SQL["line_product_dims"] = f"WITH {_DIMS} SELECT aisle, department, count(*) AS n, count(DISTINCT product_id) AS n_products FROM ld GROUP BY 1, 2"
SQL["reorder_ratio"] = f"WITH {_LINES} SELECT eval_set, round(sum(reordered) / count(*), 6) AS ratio FROM bl GROUP BY 1"
SQL["no_reorder_share"] = f"WITH {_LINES}, o AS (SELECT CAST(least(sum(reordered), 1) AS BIGINT) AS any_reordered FROM bl GROUP BY order_id) SELECT any_reordered, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM o GROUP BY 1"
SQL["department_share"] = f"WITH {_DIMS} SELECT department, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ld GROUP BY 1"
SQL["reorder_by_department"] = f"WITH {_DIMS} SELECT department, round(avg(reordered), 6) AS ratio FROM ld GROUP BY 1"
SQL["reorder_by_dept_aisle"] = f"WITH {_DIMS} SELECT department, aisle, round(avg(reordered), 6) AS ratio FROM ld GROUP BY 1, 2"
SQL["reorder_by_cart_position"] = f"WITH {_LINES} SELECT least(add_to_cart_order, 70) AS position, round(avg(reordered), 6) AS ratio FROM bl GROUP BY 1"
SQL["reorder_by_dow"] = f"WITH {_TIMED} SELECT order_dow, round(avg(reordered), 6) AS ratio FROM lt GROUP BY 1"
SQL["reorder_by_hour"] = f"WITH {_TIMED} SELECT order_hour_of_day, round(avg(reordered), 6) AS ratio FROM lt GROUP BY 1"
SQL["orders_dow_hour_pivot"] = f"WITH {_ORDERS} SELECT order_dow, {', '.join(f'count(*) FILTER (order_hour_of_day = {h}) AS h{h}' for h in range(24))} FROM bo GROUP BY 1"
SQL["reorder_dow_hour_pivot"] = f"WITH {_TIMED} SELECT order_dow, {', '.join(f'round(avg(reordered) FILTER (order_hour_of_day = {h}), 6) AS h{h}' for h in range(24))} FROM lt GROUP BY 1"
SQL["top20_products"] = f"WITH {_DIMS} SELECT product_id, count(*) AS n, any_value(product_name) AS product_name FROM ld GROUP BY 1 ORDER BY n DESC, product_id LIMIT 20"
SQL["top20_aisles"] = f"WITH {_DIMS} SELECT aisle, count(*) AS n FROM ld GROUP BY 1 ORDER BY n DESC, aisle LIMIT 20"

_POINTS = f"{_RFM}, {_log('rfm', 'logs', 'customer_id AS id')}, {_std('logs', 'pts', 'id', 9)}"


def _away(a: str, b: str) -> str:
    return " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in RFM)


_START = "SELECT * FROM pts ORDER BY md5(id || ':42'), id LIMIT {k}"


def _lloyd(k: int, tag: str = "") -> str:
    """A row of m<tag> for each round: its number, the list of centres, and how far they moved in the mean. It ends as the fit
    does. Needs WITH RECURSIVE. z<tag> is the last row, a<tag> the points with the number and squared distance of their centre."""
    centre = "struct_pack(" + ", ".join(f"{f} := {f}" for f in RFM) + ")"
    mean = "struct_pack(" + ", ".join(f"{f} := round(avg({f}), 9)" for f in RFM) + ")"
    far = f"list_transform(centres, lambda c: {_away('p', 'c')})"
    return f"""m{tag} AS (
  SELECT 0 AS round, list({centre} ORDER BY md5(id || ':42'), id) AS centres, CAST(NULL AS DOUBLE) AS shift FROM ({_START.format(k=k)})
  UNION ALL
  SELECT round + 1, new, list_avg(list_transform(list_zip(centres, new), lambda z: sqrt({_away('z[1]', 'z[2]')}))) FROM (
    SELECT round, centres, list(coalesce(mean, centres[j]) ORDER BY j) AS new
    FROM (SELECT round, centres, unnest(generate_series(1, len(centres))) AS j FROM m{tag} WHERE round < {MAX_ITER} AND (shift IS NULL OR shift >= {TOL}))
    LEFT JOIN (SELECT j, {mean} AS mean FROM (SELECT p.*, list_position({far}, list_min({far})) AS j FROM m{tag}, pts p) GROUP BY j) USING (j)
    GROUP BY round, centres)),
z{tag} AS (SELECT * FROM m{tag} ORDER BY round DESC LIMIT 1),
a{tag} AS (SELECT p.*, CAST(list_position({far}, list_min({far})) - 1 AS INTEGER) AS cluster, list_min({far}) AS dist2 FROM pts p, z{tag})"""


_KM = f"RECURSIVE {_POINTS}, {_lloyd(K)}"
SQL["bounding_box"] = f"WITH {_POINTS} " + _each("SELECT '{c}' AS feature, round(min({c}), 6) AS lo, round(max({c}), 6) AS hi FROM pts", " UNION ALL ")
SQL["kmeans_init"] = f"WITH {_POINTS} SELECT CAST(row_number() OVER (ORDER BY md5(id || ':42'), id) - 1 AS INTEGER) AS cluster, {_each('round({c}, 6) AS {c}')} FROM ({_START.format(k=K)})"
SQL["kmeans_centroids"] = f"WITH {_KM} SELECT CAST(j - 1 AS INTEGER) AS cluster, {_each('round(centres[j].{c}, 6) AS {c}')} FROM (SELECT centres, unnest(generate_series(1, len(centres))) AS j FROM z)"
SQL["kmeans_assign"] = f"WITH {_KM} SELECT id, cluster FROM a"
SQL["kmeans_shift"] = f"WITH {_KM} SELECT round(shift, 6) AS shift FROM z"
SQL["kmeans_wssse"] = f"WITH {_KM} SELECT round(round(sum(dist2), 6), 4) AS wssse FROM a"
SQL["kmeans_elbow"] = f"WITH RECURSIVE {_POINTS}, {', '.join(_lloyd(k, f'_{k}') for k in ELBOW)} " + " UNION ALL ".join(f"SELECT {k} AS k, round(round(sum(dist2), 6), 4) AS wssse FROM a_{k}" for k in ELBOW)
SQL["cluster_summary"] = f"WITH {_KM} " + _each(_DESCRIBE.format(g="cluster, ", d=2, t="a", by=" GROUP BY cluster"), " UNION ALL ")
SQL["cluster_file"] = SQL["cluster_summary"]
SQL["cluster_boxes"] = f"WITH {_KM}, q AS (SELECT cluster, quantile_cont(monetary, 0.25) AS q1, quantile_cont(monetary, 0.5) AS med, quantile_cont(monetary, 0.75) AS q3 FROM a GROUP BY 1), f AS (SELECT a.cluster, monetary, q1, med, q3, monetary BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS near FROM a JOIN q USING (cluster)) SELECT cluster, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3, round(min(monetary) FILTER (near), 6) AS low, round(max(monetary) FILTER (near), 6) AS high, count(*) FILTER (NOT near) AS n_outliers FROM f GROUP BY 1"
_NAMED = f"{_KM}, named AS (SELECT cluster, rfm.* FROM a JOIN rfm ON id = customer_id)"
SQL["segment_profile"] = f"WITH {_NAMED} SELECT cluster, round(median(recency), 6) AS median_recency, round(median(frequency), 6) AS median_frequency, round(sum(monetary), 4) AS total_monetary, count(*) AS size, round(sum(monetary) / count(*), 0) AS monetary_per_member FROM named GROUP BY 1"
SQL["relative_importance"] = f"WITH {_NAMED} SELECT cluster, {_each('round(avg({c}) / any_value(m_{c}) - 1, 6) AS {c}')} FROM named, (SELECT {_each('avg({c}) AS m_{c}')} FROM named) GROUP BY 1"

_PAIR2 = " + ".join(f"(x.{f} - y.{f}) * (x.{f} - y.{f})" for f in RFM)


def _pairs(eps: float) -> str:
    return f"e AS (SELECT x.id AS a, y.id AS b FROM pts x, pts y WHERE sqrt({_PAIR2}) <= {eps}), nc AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)"


_CORES = f"{_POINTS}, {_pairs(EPS)}, core AS (SELECT id FROM nc WHERE n >= {MIN_POINTS}), ce AS (SELECT a, b FROM e WHERE a IN (FROM core) AND b IN (FROM core)), reach(i, r) AS (SELECT id, id FROM core UNION SELECT ce.b, reach.r FROM reach JOIN ce ON reach.i = ce.a WHERE reach.r < ce.b), cl AS (SELECT i AS id, min(r) AS label FROM reach GROUP BY 1)"
_LABELS = f"{_CORES}, bd AS (SELECT e.b AS id, min(label) AS label FROM e JOIN cl ON e.a = cl.id WHERE e.b NOT IN (FROM core) GROUP BY 1), al AS (FROM cl UNION ALL FROM bd), lab AS (SELECT pts.*, CAST(coalesce(number, 0) AS INTEGER) AS cluster FROM pts LEFT JOIN al USING (id) LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) AS number FROM (SELECT DISTINCT label FROM cl)) USING (label))"
SQL["eps_pairs"] = f"WITH {_POINTS} SELECT x.id AS a, y.id AS b, round(sqrt({_PAIR2}), 6) AS dist FROM pts x, pts y WHERE x.id < y.id AND sqrt({_PAIR2}) <= {PAIR_EPS}"
SQL["dbscan_neighbor_counts"] = f"WITH {_POINTS}, {_pairs(EPS)} SELECT id, n FROM nc"
SQL["dbscan_labels"] = f"WITH RECURSIVE {_LABELS} SELECT id, cluster FROM lab"
SQL["dbscan_border_as_noise"] = f"WITH RECURSIVE {_LABELS} SELECT id, CASE WHEN id IN (FROM core) THEN cluster ELSE 0 END AS cluster FROM lab"
SQL["dbscan_num_clusters"] = f"WITH RECURSIVE {_LABELS} SELECT count(DISTINCT cluster) AS n_clusters FROM lab WHERE cluster <> 0"
SQL["dbscan_cluster_sizes"] = f"WITH RECURSIVE {_LABELS} SELECT cluster, count(*) AS n FROM lab GROUP BY 1"
SQL["dbscan_noise_count"] = f"WITH RECURSIVE {_LABELS} SELECT count(*) AS n_noise FROM lab WHERE cluster = 0"
_MOVED = " + ".join(f"(x.{f} + {SHIFT} - y.{f}) * (x.{f} + {SHIFT} - y.{f})" for f in RFM)
SQL["dbscan_predict"] = f"""WITH RECURSIVE {_LABELS}, nb AS (SELECT x.id, y.cluster, count(*) AS n FROM pts x, lab y WHERE sqrt({_MOVED}) <= {EPS} GROUP BY 1, 2),
pr AS (SELECT id, min(CASE WHEN cluster <> 0 AND n >= {MIN_POINTS - 1} THEN cluster END) AS f, min(CASE WHEN cluster <> 0 THEN cluster END) AS s, max(CASE WHEN cluster = 0 AND n >= {MIN_POINTS - 1} THEN 1 END) AS q FROM nb GROUP BY 1)
SELECT id, CAST(coalesce(f, s, CASE WHEN q = 1 THEN -1 END, 0) AS INTEGER) AS cluster FROM pts LEFT JOIN pr USING (id)"""
_NN = f"{_POINTS}, nn AS (SELECT x.id, min(sqrt({_PAIR2})) AS dist FROM pts x, pts y WHERE x.id <> y.id GROUP BY 1)"
SQL["nn_distance"] = f"WITH {_NN} SELECT id, round(dist, 6) AS dist FROM nn"
SQL["nn_histogram"] = f"WITH {_NN}, nr AS (SELECT round(dist, 9) AS dist FROM nn), {_histogram('nr', 'dist', BUCKETS, 6)}"
SQL["neighbor_histogram"] = f"WITH {_POINTS}, {_pairs(EPS)}, {_histogram('nc', 'n', BUCKETS, 6)}"
