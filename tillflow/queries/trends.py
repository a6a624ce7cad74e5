"""Time series, windows, customer analytics, baskets and lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.numbers import pct_delta as delta
from ..functions.numbers import percent
from ..operators import timeseries as ts
from ..operators.dedup import keep_one
from ..operators.fill import fill_directional
from ..operators.ranking import half_split
from ..plans import baskets, customers, marts
from .registry import query, table
from .sqlbits import CUSTOMERS, HEADERS, ITEMS, LINES, PRODUCTS, SELLERS, big, dbl, mean_money, pct_delta

# Orders without those of every June, so that the calendar has gaps to fill.
GAPPED = "gapped AS (SELECT o_orderdate AS d, cast(o_totalprice as decimal(12,2)) AS v, o_custkey FROM orders WHERE month(o_orderdate) <> 6)"
WHOLE = "whole AS (SELECT o_orderdate AS d, cast(o_totalprice as decimal(12,2)) AS v, o_custkey FROM orders)"


def series_sql(unit: str, step: str, bucket: str | None = None, rows: str = "gapped") -> str:
    bucket = bucket or f"cast(date_trunc('{unit}', d) as date)"
    return f"""{GAPPED if rows == 'gapped' else WHOLE}, b AS (SELECT {bucket} AS period, sum(v) AS s, avg(v) AS a, count(v) AS c, min(v) AS lo, max(v) AS hi, median(v::double) AS md FROM {rows} GROUP BY 1),
    spine AS (SELECT cast(unnest(generate_series((SELECT min(period) FROM b)::timestamp, (SELECT max(period) FROM b)::timestamp, INTERVAL {step})) as date) AS period),
    t AS (SELECT period, coalesce(s, 0) AS value, a, coalesce(c, 0) AS c, lo, hi, md FROM spine LEFT JOIN b USING (period))"""


MONTHLY = series_sql("month", "1 MONTH")
WHOLE_MONTHLY = series_sql("month", "1 MONTH", rows="whole")
WEEK_BUCKET = "cast(date_trunc('week', d - INTERVAL 1 DAY) as date) + 7"
GROWTH = "CASE WHEN {b} = 0 THEN NULL ELSE cast(value - {b} as double) / cast({b} as double) * 100.0 END"


def whole(spark, sf):
    return views.order_headers(spark, sf).select("purchased_at", "order_amount", "customer_id")


def gapped(spark, sf):
    return whole(spark, sf).filter(F.month("purchased_at") != 6)


def monthly(spark, sf):
    return ts.resample(gapped(spark, sf), "purchased_at", "order_amount", "monthly")


def whole_monthly(spark, sf):
    return ts.resample(whole(spark, sf), "purchased_at", "order_amount", "monthly")


@query(
    "resample_monthly",
    f"""WITH {MONTHLY} SELECT period, strftime(period, '%b %Y') AS period_label, {dbl('value')} AS total, round({dbl('a')}, 4) AS average, c AS orders,
    {dbl('lo')} AS smallest, {dbl('hi')} AS largest, round(md, 4) AS median FROM t""",
)
def resample_monthly(spark, sf):
    out = ts.label(ts.resample_measures(gapped(spark, sf), "purchased_at", "order_amount", "monthly"), "monthly")
    return out.select(
        "period",
        "period_label",
        F.col("sum").cast("double").alias("total"),
        F.round(F.col("avg").cast("double"), 4).alias("average"),
        F.col("count").alias("orders"),
        F.col("min").cast("double").alias("smallest"),
        F.col("max").cast("double").alias("largest"),
        F.round("median", 4).alias("median"),
    )


@query(
    "resample_weekly",
    f"""WITH {series_sql('week', '7 DAY', WEEK_BUCKET)} SELECT period, 'W' || strftime(period, '%W %Y') AS period_label, {dbl('value')} AS total FROM t""",
)
def resample_weekly(spark, sf):
    out = ts.label(ts.resample(gapped(spark, sf), "purchased_at", "order_amount", "weekly"), "weekly")
    return out.select("period", "period_label", F.col("value").cast("double").alias("total"))


@query(
    "resample_quarterly",
    f"""WITH {series_sql('quarter', '3 MONTH')} SELECT period, year(period) || 'Q' || quarter(period) AS period_label, {dbl('value')} AS total FROM t""",
)
def resample_quarterly(spark, sf):
    out = ts.label(ts.resample(gapped(spark, sf), "purchased_at", "order_amount", "quarterly"), "quarterly")
    return out.select("period", "period_label", F.col("value").cast("double").alias("total"))


@query("ts_pop_growth", f"WITH {MONTHLY}, l AS (SELECT *, lag(value) OVER (ORDER BY period) AS b FROM t) SELECT period, round({GROWTH.format(b='b')}, 6) AS growth_pct FROM l")
def ts_pop_growth(spark, sf):
    return ts.with_growth(monthly(spark, sf), "monthly").select("period", F.round("pop_growth_pct", 6).alias("growth_pct"))


@query(
    "ts_rolling3",
    f"WITH {WHOLE_MONTHLY} SELECT period, round(avg(value::double) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rolling_3_avg FROM t",
)
def ts_rolling3(spark, sf):
    series = whole_monthly(spark, sf).withColumn("value", F.col("value").cast("double"))
    return ts.with_growth(series, "monthly").select("period", F.round("rolling_3_avg", 2).alias("rolling_3_avg"))


@query("ts_cumulative", f"WITH {WHOLE_MONTHLY} SELECT period, {dbl('sum(value) OVER (ORDER BY period)')} AS cumulative_total FROM t")
def ts_cumulative(spark, sf):
    return ts.with_growth(whole_monthly(spark, sf), "monthly").select("period", F.col("cumulative_total").cast("double").alias("cumulative_total"))


@query("ts_yoy", f"WITH {MONTHLY}, l AS (SELECT *, lag(value, 12) OVER (ORDER BY period) AS b FROM t) SELECT period, round({GROWTH.format(b='b')}, 6) AS yoy_growth_pct FROM l")
def ts_yoy(spark, sf):
    return ts.with_growth(monthly(spark, sf), "monthly").select("period", F.round("yoy_growth_pct", 6).alias("yoy_growth_pct"))


@query(
    "peak_period",
    f"""WITH {WHOLE_MONTHLY}, l AS (SELECT *, lag(value) OVER (ORDER BY period) AS b FROM t), g AS (SELECT *, {GROWTH.format(b='b')} AS g FROM l)
    SELECT (SELECT period FROM t ORDER BY value DESC, period LIMIT 1) AS peak, {dbl('max(value)')} AS peak_value, max(period) AS latest_period,
    round((SELECT g FROM g ORDER BY period DESC LIMIT 1), 6) AS latest_growth_pct FROM g""",
)
def peak_period(spark, sf):
    out = ts.peak_period(whole_monthly(spark, sf))
    return out.withColumns({"peak_value": F.col("peak_value").cast("double"), "latest_growth_pct": F.round("latest_growth_pct", 6)})


@query(
    "quarter_vs_target",
    f"""WITH {series_sql('quarter', '3 MONTH', rows='whole')} SELECT year(period) || 'Q' || quarter(period) AS quarter, {dbl('value')} AS actual,
    round({dbl('value')} * 0.92, 2) AS target FROM t""",
)
def quarter_vs_target(spark, sf):
    return quarter_targets(ts.resample(whole(spark, sf), "purchased_at", "order_amount", "quarterly"), 0.92)


def quarter_targets(series, factor):
    actual = F.col("value").cast("double")
    labelled = ts.label(series, "quarterly")
    return labelled.select(F.col("period_label").alias("quarter"), actual.alias("actual"), F.round(actual * factor, 2).alias("target"))


@query(
    "forecast_linear",
    f"""WITH {WHOLE_MONTHLY}, x AS (SELECT row_number() OVER (ORDER BY period) - 1 AS t, value::double AS v, period FROM t),
    f AS (SELECT regr_slope(v, t) AS m, regr_intercept(v, t) AS c, count(*) AS n, max(period) AS last FROM x),
    s AS (SELECT stddev_pop(v - (m * t + c)) AS sd FROM x, f),
    h AS (SELECT unnest([1, 2, 3]) AS step), p AS (SELECT step, last, sd, m, greatest(0.0, m * (n - 1 + step) + c) AS y FROM f, s, h)
    SELECT cast(last + to_months(step) as date) AS period, round(y, 2) AS forecast, round(greatest(0.0, y - 1.96 * sd), 2) AS lower, round(y + 1.96 * sd, 2) AS upper,
    CASE WHEN m > 0 THEN 'Upward' ELSE 'Downward' END AS trend FROM p""",
)
def forecast_linear(spark, sf):
    out = ts.forecast(whole_monthly(spark, sf), 3)
    return out.withColumns({c: F.round(c, 2) for c in ("forecast", "lower", "upper")})


@query(
    "anomaly_zscore",
    f"""WITH {WHOLE_MONTHLY}, m AS (SELECT period, value::double AS v, avg(value::double) OVER () AS mu, stddev_samp(value::double) OVER () AS sd FROM t),
    z AS (SELECT *, (v - mu) / sd AS z FROM m) SELECT period, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS type,
    CASE WHEN z > 2.8 OR z < -2.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, v AS observed, round(mu, 2) AS expected,
    round((v - mu) / mu * 100.0, 6) AS deviation_pct, round(z, 6) AS z FROM z WHERE z > 2.0 OR z < -1.8""",
)
def anomaly_zscore(spark, sf):
    out = ts.zscore_anomalies(whole_monthly(spark, sf))
    return out.withColumns({"expected": F.round("expected", 2), "deviation_pct": F.round("deviation_pct", 6), "z": F.round("z", 6)})


@query(
    "anomaly_skew",
    f"""WITH {PRODUCTS}, {ITEMS}, t AS (SELECT CASE WHEN category IN ('PROMO', 'SMALL') THEN category ELSE 'REST' END AS grp, item_price FROM items JOIN products USING (product_id)),
    g AS (SELECT grp, sum(item_price) AS v FROM t GROUP BY 1)
    SELECT 'skew' AS type, 'MEDIUM' AS severity, arg_max(grp, v) AS subject, {dbl('max(v)')} AS observed, round({dbl('sum(v)')} / count(*), 4) AS expected,
    round({dbl('max(v)')} * 100.0 / {dbl('sum(v)')}, 6) AS share_pct FROM g""",
)
def anomaly_skew(spark, sf):
    group = F.when(F.col("category").isin("PROMO", "SMALL"), F.col("category")).otherwise("REST")
    joined = views.order_items(spark, sf).join(views.products(spark, sf), "product_id").withColumn("grp", group)
    out = ts.concentration_anomaly(joined, "grp", F.col("item_price"))
    return out.withColumns({"expected": F.round("expected", 4), "share_pct": F.round("share_pct", 6)})


# --- windows -----------------------------------------------------------------------------------

HALF = f"""{HEADERS}, r AS (SELECT order_amount AS v, purchased_at, row_number() OVER (ORDER BY cast(purchased_at as date), order_id) AS rn, count(*) OVER () AS n FROM headers),
h AS (SELECT max(n) AS n, sum(CASE WHEN rn <= n // 2 THEN v ELSE 0 END) AS p1, sum(CASE WHEN rn > n // 2 THEN v ELSE 0 END) AS p2 FROM r)"""


@query(
    "half_split_growth",
    f"""WITH {HALF} SELECT n AS rows, n // 2 AS first_rows, {dbl('p1')} AS first_sum, {dbl('p2')} AS second_sum,
    round({dbl('p2 - p1')} / {dbl('p1')} * 100.0, 6) AS growth_pct FROM h""",
)
def half_split_growth(spark, sf):
    out = half_split(views.order_headers(spark, sf), "purchased_at", "order_id", "order_amount")
    growth = F.round(percent(F.col("second_sum") - F.col("first_sum"), F.col("first_sum")), 6)
    return marts.as_double(out.withColumn("growth_pct", growth), "first_sum", "second_sum")


@query(
    "period_compare",
    f"""WITH {HALF} SELECT {dbl('p1')} AS previous, {dbl('p2')} AS current, {dbl('p2 - p1')} AS difference,
    round({pct_delta(dbl('p1'), dbl('p2'))}, 6) AS difference_pct, p2 >= p1 AS is_growth FROM h""",
)
def period_compare(spark, sf):
    from ..operators.compare import period_compare as compare

    out = compare(views.order_headers(spark, sf), "purchased_at", "order_id", "order_amount")
    return out.withColumn("difference_pct", F.round("difference_pct", 6))


@query(
    "segment_rank",
    f"""WITH {HEADERS}, {CUSTOMERS} SELECT segment, {dbl('sum(order_amount)')} AS revenue, row_number() OVER (ORDER BY sum(order_amount) DESC, segment) AS rank
    FROM headers JOIN customers USING (customer_id) GROUP BY segment""",
)
def segment_rank(spark, sf):
    from ..operators.kpis import rank_groups

    joined = views.order_headers(spark, sf).join(views.customers(spark, sf), "customer_id")
    return marts.as_double(rank_groups(joined, "segment", F.col("order_amount")), "revenue")


PER_CUSTOMER = """c AS (SELECT customer_id, sum(order_amount) AS monetary, count(*) AS frequency, max(cast(purchased_at as date)) AS last_day FROM headers GROUP BY 1)"""


def per_customer(spark, sf):
    return views.order_headers(spark, sf).groupBy("customer_id").agg(
        F.sum("order_amount").alias("monetary"), F.count(F.lit(1)).alias("frequency"), F.max(F.to_date("purchased_at")).alias("last_day")
    )


@query(
    "pareto_share",
    f"""WITH {HEADERS}, {PER_CUSTOMER}, r AS (SELECT monetary, row_number() OVER (ORDER BY monetary DESC) AS rn, count(*) OVER () AS n, sum(monetary) OVER () AS tot FROM c),
    k AS (SELECT *, greatest(1, cast(floor(n * 0.2) as bigint)) AS k1, greatest(1, cast(round_even(n * 0.2, 0) as bigint)) AS k2 FROM r)
    SELECT max(n) AS accounts, max(k1) AS floor20_accounts, max(k2) AS round20_accounts,
    round(100.0 * {dbl('sum(CASE WHEN rn <= k1 THEN monetary END)')} / {dbl('max(tot)')}, 6) AS floor20_share_pct,
    round(100.0 * {dbl('sum(CASE WHEN rn <= k2 THEN monetary END)')} / {dbl('max(tot)')}, 6) AS round20_share_pct,
    round(100.0 * {dbl('sum(CASE WHEN rn <= 5 THEN monetary END)')} / {dbl('max(tot)')}, 6) AS top5_share_pct,
    round(100.0 * {dbl('sum(CASE WHEN rn <= 10 THEN monetary END)')} / {dbl('max(tot)')}, 6) AS top10_share_pct FROM k""",
)
def pareto_share(spark, sf):
    return customers.pareto(per_customer(spark, sf), "monetary")


@query(
    "rfm_tiers",
    f"""WITH {HEADERS}, {PER_CUSTOMER}, m AS (SELECT customer_id, cast(datediff('day', last_day, max(last_day) OVER ()) as integer) AS recency_days, frequency, {dbl('monetary')} AS monetary FROM c),
    q AS (SELECT quantile_cont(recency_days::double, [0.2, 0.4, 0.6, 0.8]) AS a, quantile_cont(frequency::double, [0.2, 0.4, 0.6, 0.8]) AS b, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS d FROM m),
    s AS (SELECT m.*, cast(5 - len(list_filter(a, lambda x: recency_days > x)) as integer) AS r, cast(1 + len(list_filter(b, lambda x: frequency > x)) as integer) AS f,
      cast(1 + len(list_filter(d, lambda x: monetary > x)) as integer) AS m FROM m, q)
    SELECT customer_id, recency_days, frequency, monetary, r, f, m, CASE WHEN r + f + m >= 12 THEN 'Champions' WHEN r + f + m >= 9 THEN 'Loyal'
      WHEN r + f + m >= 6 THEN 'Regular' ELSE 'At Risk' END AS tier FROM s""",
)
def rfm_tiers(spark, sf):
    return customers.rfm_tiers(per_customer(spark, sf))


@query(
    "inactivity_proxy",
    f"""WITH {HEADERS}, {PER_CUSTOMER} SELECT customer_id, cast(datediff('day', last_day, max(last_day) OVER ()) as integer) AS days_since_last,
    datediff('day', last_day, max(last_day) OVER ()) > 180 AS is_inactive FROM c""",
)
def inactivity_proxy(spark, sf):
    return customers.inactivity(per_customer(spark, sf).select("customer_id", "last_day"))


@query(
    "dedup_by_key",
    f"""SELECT order_id, order_item_id, product_id, seller_id, price FROM (SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
    l_extendedprice AS price, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_by_key(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
    )
    return keep_one(items, ["order_id", "order_item_id"], [F.col("price").desc(), F.col("product_id"), F.col("seller_id")])


@query(
    "prior_month_growth",
    f"""WITH {LINES}, b AS (SELECT cast(date_trunc('month', purchased_at) as date) AS period, sum(total_item_value) AS r, count(DISTINCT order_id) AS o FROM lines WHERE month(purchased_at) <> 6 GROUP BY 1),
    spine AS (SELECT cast(unnest(generate_series((SELECT min(period) FROM b)::timestamp, (SELECT max(period) FROM b)::timestamp, INTERVAL 1 MONTH)) as date) AS period),
    t AS (SELECT period, coalesce(r, 0) AS r, coalesce(o, 0) AS o FROM spine LEFT JOIN b USING (period)),
    l AS (SELECT *, lag(r) OVER (ORDER BY period) AS pr, lag(o) OVER (ORDER BY period) AS po FROM t)
    SELECT period, {dbl('r')} AS revenue, o AS orders, {dbl('pr')} AS prior_revenue,
    round(CASE WHEN pr = 0 THEN NULL ELSE {dbl('r - pr')} / {dbl('pr')} * 100.0 END, 6) AS revenue_growth_pct,
    round(CASE WHEN po = 0 THEN NULL ELSE (o - po)::double / po * 100.0 END, 6) AS order_growth_pct FROM l""",
)
def prior_month_growth(spark, sf):
    from pyspark.sql import Window as W

    headers = views.order_headers(spark, sf).filter(F.month("purchased_at") != 6)
    orders = marts.orders_with_revenue(views.order_items(spark, sf), headers)
    revenue = ts.resample(orders, "purchased_at", "gross_order_revenue", "monthly").withColumnRenamed("value", "revenue")
    count = ts.resample(orders, "purchased_at", "gross_order_revenue", "monthly", "count").withColumnRenamed("value", "orders")
    order = W.partitionBy(F.lit(0)).orderBy("period")
    out = revenue.join(count, "period").withColumns(
        {"prior_revenue": F.lag("revenue").over(order), "_po": F.lag("orders").over(order)}
    )
    out = out.withColumns(
        {
            "revenue_growth_pct": F.round(ts.growth(F.col("revenue"), F.col("prior_revenue")), 6),
            "order_growth_pct": F.round(ts.growth(F.col("orders"), F.col("_po")), 6),
        }
    ).drop("_po")
    return marts.as_double(out, "revenue", "prior_revenue")


@query(
    "fill_directional",
    """WITH t AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
    SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward,
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM t""",
)
def fill_direction(spark, sf):
    known = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    events = views.order_events(spark, sf).select("event_id", "user_id", "ts", known.alias("forward"), known.alias("backward"))
    day = F.to_date("ts")
    out = fill_directional(events, ["user_id"], ["ts", "event_id"], "forward", day)
    out = fill_directional(out, ["user_id"], ["ts", "event_id"], "backward", day, backward=True)
    return out.select("event_id", "forward", "backward")


# --- summaries ---------------------------------------------------------------------------------


def summary_sql(group: str, joins: str, tables: str) -> str:
    return f"""WITH {tables}, g AS (SELECT {group}, sum(total_item_value) AS revenue, sum(item_price - freight_value) AS profit, count(*) AS transactions, sum(quantity) AS quantity
    FROM {joins} GROUP BY 1) SELECT {group}, row_number() OVER (ORDER BY revenue DESC, {group}) AS rank, {dbl('revenue')} AS revenue,
    round(100.0 * {dbl('revenue')} / {dbl('sum(revenue) OVER ()')}, 6) AS share_pct, {dbl('profit')} AS profit, round(100.0 * {dbl('profit')} / {dbl('revenue')}, 6) AS margin_pct,
    transactions, quantity FROM g"""


def summary(lines, group: str):
    grouped = lines.groupBy(group).agg(
        F.sum("total_item_value").alias("revenue"),
        F.sum(F.col("item_price") - F.col("freight_value")).alias("profit"),
        F.count(F.lit(1)).alias("transactions"),
        F.sum("quantity").alias("quantity"),
    )
    return customers.segment_summary(grouped, group)


@query("segment_summary", summary_sql("category", "items JOIN products USING (product_id)", f"{ITEMS}, {PRODUCTS}"))
def segment_summary(spark, sf):
    return summary(views.order_items(spark, sf).join(views.products(spark, sf), "product_id"), "category")


@query("account_summary", summary_sql("customer_id", "lines", LINES))
def account_summary(spark, sf):
    headers = views.order_headers(spark, sf).select("order_id", "customer_id")
    return summary(views.order_items(spark, sf).join(headers, "order_id"), "customer_id")


@query("region_summary", summary_sql("region", "lines JOIN customers USING (customer_id)", f"{LINES}, {CUSTOMERS}"))
def region_summary(spark, sf):
    headers = views.order_headers(spark, sf).select("order_id", "customer_id")
    lines = views.order_items(spark, sf).join(headers, "order_id")
    return summary(lines.join(views.customers(spark, sf).select("customer_id", "region"), "customer_id"), "region")


@query(
    "month_share",
    f"""WITH {HEADERS}, g AS (SELECT order_year_month AS period, sum(order_amount) AS revenue, count(*) AS transactions FROM headers GROUP BY 1)
    SELECT period, {dbl('revenue')} AS revenue, transactions, round(100.0 * {dbl('revenue')} / {dbl('sum(revenue) OVER ()')}, 6) AS share_pct FROM g""",
)
def month_share(spark, sf):
    from ..operators.kpis import month_share as shares

    return shares(views.order_headers(spark, sf), "order_year_month", F.col("order_amount"))


@query(
    "business_alerts",
    f"""WITH {LINES}, {PRODUCTS}, t AS (SELECT lines.*, category, CASE WHEN order_id % 17 = 0 THEN NULL ELSE item_price - 1500 END AS profit FROM lines JOIN products USING (product_id)),
    a AS (SELECT (SELECT count(*) FROM t WHERE profit < 0) AS neg, (SELECT count(*) FROM t WHERE profit IS NULL) AS mis,
      (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM t GROUP BY order_id, order_item_id)) AS dup,
      (SELECT max(s) FROM (SELECT sum(total_item_value) AS s FROM t GROUP BY customer_id))::double * 100.0 / (SELECT sum(total_item_value) FROM t)::double AS acc,
      (SELECT max(s) FROM (SELECT sum(total_item_value) AS s FROM t GROUP BY category))::double * 100.0 / (SELECT sum(total_item_value) FROM t)::double AS cat)
    SELECT 'WARNING' AS severity, 'missing_values' AS alert, mis::double AS value FROM a WHERE mis > 0 UNION ALL SELECT 'WARNING', 'duplicate_rows', dup::double FROM a WHERE dup > 0
    UNION ALL SELECT 'WARNING', 'negative_profit', neg::double FROM a WHERE neg > 0 UNION ALL SELECT 'WARNING', 'account_concentration', round(acc, 6) FROM a WHERE acc > 35
    UNION ALL SELECT 'WARNING', 'category_concentration', round(cat, 6) FROM a WHERE cat > 60""",
)
def business_alerts(spark, sf):
    from ..operators.kpis import business_alerts as alerts

    lines = views.order_items(spark, sf).join(views.order_headers(spark, sf), "order_id")
    lines = lines.join(views.products(spark, sf).select("product_id", "category"), "product_id")
    profit = F.when(F.col("order_id") % 17 != 0, F.col("item_price") - 1500)
    return alerts(lines.withColumn("profit", profit), ["order_id", "order_item_id"], "total_item_value", "profit", "customer_id", "category")


# --- baskets, prices, lanes --------------------------------------------------------------------


@query(
    "price_distribution",
    f"""WITH {ITEMS}, b AS (SELECT min(item_price)::double AS lo, max(item_price)::double AS hi, round(quantile_cont(item_price::double, 0.25), 6) AS p25,
      round(quantile_cont(item_price::double, 0.5), 6) AS median, round(quantile_cont(item_price::double, 0.75), 6) AS p75 FROM items)
    SELECT least(10, cast(floor((item_price::double - lo) * 10 / (hi - lo)) as bigint) + 1) AS bucket, count(*) AS items, {dbl('sum(item_price)')} AS revenue,
    max(p25) AS p25, max(median) AS median, max(p75) AS p75 FROM items, b GROUP BY 1""",
)
def price_distribution(spark, sf):
    return baskets.price_histogram(views.order_items(spark, sf), "item_price", 10)


@query(
    "basket_sizes",
    f"""WITH {ITEMS}, o AS (SELECT order_id, count(*) AS n, sum(total_item_value) AS g FROM items GROUP BY 1)
    SELECT n AS total_items_count, count(*) AS orders, {dbl('sum(g)')} AS revenue FROM o GROUP BY 1""",
)
def basket_sizes(spark, sf):
    return baskets.basket_sizes(marts.order_revenue(views.order_items(spark, sf)))


@query(
    "basket_pairs",
    f"""WITH {ITEMS}, {PRODUCTS}, d AS (SELECT DISTINCT order_id, category FROM items JOIN products USING (product_id))
    SELECT a.category AS category_a, b.category AS category_b, count(*) AS orders_together FROM d a JOIN d b ON a.order_id = b.order_id AND a.category < b.category GROUP BY 1, 2""",
)
def basket_pairs(spark, sf):
    return baskets.basket_pairs(views.order_items(spark, sf), views.products(spark, sf), "category")


@query(
    "sku_ranking",
    f"""WITH {ITEMS}, {PRODUCTS}, g AS (SELECT product_id, category, sum(total_item_value) AS revenue, {big('sum(order_item_quantity)')} AS units FROM items JOIN products USING (product_id) GROUP BY 1, 2),
    r AS (SELECT *, cast(row_number() OVER (PARTITION BY category ORDER BY revenue DESC, product_id) as integer) AS rank FROM g)
    SELECT product_id, category, {dbl('revenue')} AS revenue, units, rank FROM r WHERE rank <= 10""",
)
def sku_ranking(spark, sf):
    return baskets.sku_ranking(views.order_items(spark, sf), views.products(spark, sf), 10)


@query(
    "freight_by_state",
    f"""WITH {LINES}, {CUSTOMERS} SELECT state, {mean_money('sum(freight_value)', 'count(*)')} AS average_freight,
    round(100.0 * {dbl('sum(freight_value)')} / {dbl('sum(total_item_value)')}, 6) AS freight_share_pct,
    round(100.0 * sum(CASE WHEN delivered_at > estimated_at THEN 1 ELSE 0 END)::double / count(*), 6) AS delayed_pct FROM lines JOIN customers USING (customer_id) GROUP BY state""",
)
def freight_by_state(spark, sf):
    return baskets.freight_by_state(views.order_items(spark, sf), views.order_headers(spark, sf), views.customers(spark, sf))


@query(
    "lane_latency",
    f"""WITH {LINES}, {CUSTOMERS}, {SELLERS}, t AS (SELECT seller_state AS from_state, state AS to_state, datediff('day', purchased_at, delivered_at) AS d, delivered_at > estimated_at AS late
      FROM lines JOIN customers USING (customer_id) JOIN sellers USING (seller_id))
    SELECT from_state, to_state, count(*) AS items, round(avg(d), 6) AS average_days, quantile_cont(d::double, 0.5) AS median_days, round(quantile_cont(d::double, 0.9), 9) AS p90_days,
    round(100.0 * sum(CASE WHEN late THEN 1 ELSE 0 END)::double / count(*), 6) AS delayed_pct FROM t GROUP BY 1, 2""",
)
def lane_latency(spark, sf):
    out = baskets.lane_latency(
        views.order_items(spark, sf), views.order_headers(spark, sf), views.customers(spark, sf), views.sellers(spark, sf)
    )
    return out.withColumn("p90_days", F.round("p90_days", 9))


@query(
    "event_throughput",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2""",
)
def event_throughput(spark, sf):
    out = baskets.throughput(views.order_events(spark, sf), "1 minute")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
