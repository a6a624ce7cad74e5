"""Marts, joins and plain aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.dates import date_key
from ..functions.keys import surrogate_key
from ..functions.numbers import ratio
from ..operators.reconcile import column_tests as tests
from ..operators.reconcile import revenue_reconciliation
from ..plans import marts
from .registry import query, table
from .sqlbits import CUSTOMERS, HEADERS, ITEMS, LINES, PRODUCTS, SELLERS, big, dbl, mean_money


@query(
    "sales_summary",
    f"""WITH {ITEMS} SELECT count(DISTINCT order_id) AS total_orders, {big('sum(order_item_quantity)')} AS total_units_sold,
    {dbl('sum(item_price)')} AS total_product_revenue, {dbl('sum(freight_value)')} AS total_freight_revenue,
    {dbl('sum(total_item_value)')} AS total_gross_revenue,
    {mean_money('sum(total_item_value)', 'count(DISTINCT order_id)')} AS average_order_value FROM items""",
)
def sales_summary(spark, sf):
    return marts.sales_summary(views.order_items(spark, sf))


@query(
    "order_revenue",
    f"""WITH {ITEMS} SELECT order_id, count(order_item_id) AS total_items_count, {big('sum(order_item_quantity)')} AS total_quantity,
    {dbl('sum(item_price)')} AS product_revenue, {dbl('sum(freight_value)')} AS freight_revenue,
    {dbl('sum(total_item_value)')} AS gross_order_revenue FROM items GROUP BY order_id""",
)
def order_revenue(spark, sf):
    out = marts.order_revenue(views.order_items(spark, sf))
    return marts.as_double(out, "product_revenue", "freight_revenue", "gross_order_revenue")


@query(
    "daily_sales",
    f"""WITH {LINES} SELECT order_date_key, order_year_month, count(DISTINCT order_id) AS daily_orders,
    {big('sum(order_item_quantity)')} AS daily_units_sold, {dbl('sum(item_price)')} AS daily_product_revenue,
    {dbl('sum(freight_value)')} AS daily_freight_revenue, {dbl('sum(total_item_value)')} AS daily_gross_revenue,
    {mean_money('sum(total_item_value)', 'count(DISTINCT order_id)')} AS daily_aov
    FROM lines GROUP BY order_date_key, order_year_month""",
)
def daily_sales(spark, sf):
    return marts.daily_sales(views.order_items(spark, sf), views.order_headers(spark, sf))


@query(
    "monthly_trend",
    f"""WITH {LINES} SELECT order_year_month, {dbl('sum(total_item_value)')} AS revenue, count(DISTINCT order_id) AS orders,
    {big('sum(order_item_quantity)')} AS units FROM lines GROUP BY order_year_month""",
)
def monthly_trend(spark, sf):
    return marts.monthly_trend(views.order_items(spark, sf), views.order_headers(spark, sf))


@query(
    "regional_sales",
    f"""WITH {LINES}, {CUSTOMERS} SELECT state, count(DISTINCT order_id) AS total_orders,
    {big('sum(order_item_quantity)')} AS units_sold, {dbl('sum(total_item_value)')} AS regional_gross_revenue
    FROM lines JOIN customers USING (customer_id) GROUP BY state""",
)
def regional_sales(spark, sf):
    return marts.regional_sales(
        views.order_items(spark, sf), views.order_headers(spark, sf), views.customers(spark, sf)
    )


@query(
    "product_performance",
    f"""WITH {ITEMS}, {PRODUCTS} SELECT category AS category_name, count(DISTINCT order_id) AS orders_count,
    {big('sum(order_item_quantity)')} AS units_sold, {dbl('sum(total_item_value)')} AS category_revenue
    FROM items JOIN products USING (product_id) GROUP BY category""",
)
def product_performance(spark, sf):
    return marts.product_performance(views.order_items(spark, sf), views.products(spark, sf))


@query(
    "customer_value",
    f"""WITH {LINES}, {CUSTOMERS} SELECT customer_unique_id, count(DISTINCT order_id) AS lifetime_orders_count,
    {dbl('sum(total_item_value)')} AS observed_clv, min(order_year_month) AS first_order_month,
    max(order_year_month) AS latest_order_month FROM lines JOIN customers USING (customer_id) GROUP BY customer_unique_id""",
)
def customer_value(spark, sf):
    return marts.customer_value(
        views.order_items(spark, sf), views.order_headers(spark, sf), views.customers(spark, sf)
    )


@query(
    "executive_kpis",
    f"""WITH {LINES} SELECT {dbl('sum(total_item_value)')} AS total_gross_revenue, count(DISTINCT order_id) AS total_orders,
    {big('sum(order_item_quantity)')} AS units_sold,
    {mean_money('sum(total_item_value)', 'count(DISTINCT order_id)')} AS average_order_value,
    {mean_money('sum(freight_value)', 'sum(order_item_quantity)')} AS average_freight_per_item,
    count(DISTINCT customer_id) AS customers FROM lines""",
)
def executive_kpis(spark, sf):
    return marts.executive_kpis(views.order_items(spark, sf), views.order_headers(spark, sf))


@query(
    "customer_measures",
    f"""WITH {LINES}, c AS (SELECT customer_id, count(DISTINCT order_id) AS n, sum(total_item_value) AS g FROM lines GROUP BY 1)
    SELECT count(*) AS unique_customers, {mean_money('sum(g)', 'count(*)')} AS revenue_per_customer,
    round(100.0 * sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::double / count(*), 6) AS repeat_rate_pct FROM c""",
)
def customer_measures(spark, sf):
    return marts.customer_measures(views.order_items(spark, sf), views.order_headers(spark, sf))


@query(
    "orders_distinct",
    f"""WITH {LINES} SELECT DISTINCT order_id, order_status, order_year_month,
    strftime(purchased_at, '%Y-%m-%d %H:%M:%S') AS purchased_at FROM lines""",
)
def orders_distinct(spark, sf):
    lines = views.order_items(spark, sf).select("order_id").distinct()
    headers = views.order_headers(spark, sf)
    joined = lines.join(headers, "order_id")
    return joined.select(
        "order_id", "order_status", "order_year_month", F.date_format("purchased_at", "yyyy-MM-dd HH:mm:ss").alias("purchased_at")
    ).distinct()


@query(
    "grain_violations",
    """SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, count(*) AS occurrences
    FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def grain_violations(spark, sf):
    return marts.grain_violations(views.order_items(spark, sf))


@query(
    "revenue_reconcile",
    f"""WITH {LINES}, s AS (SELECT sum(item_price) AS p, sum(freight_value) AS f, sum(total_item_value) AS t FROM items),
    g AS (SELECT sum(item_price) AS p, sum(total_item_value) AS t FROM lines WHERE order_status <> 'P')
    SELECT {dbl('s.p')} AS source_item_revenue, {dbl('s.f')} AS source_freight_revenue, {dbl('s.t')} AS source_total_revenue,
    {dbl('g.p')} AS target_item_revenue, {dbl('g.t')} AS target_total_revenue, {dbl('g.t - s.t')} AS revenue_variance,
    CASE WHEN abs(g.t - s.t) < 0.01 THEN 'EXACT_MATCH' ELSE 'VARIANCE_DETECTED' END AS reconciliation_status FROM s, g""",
)
def revenue_reconcile(spark, sf):
    """Source items against a target that lacks the pending orders, so that a variance shows."""
    items = views.order_items(spark, sf)
    open_orders = views.order_headers(spark, sf).filter(F.col("order_status") != "P").select("order_id")
    return revenue_reconciliation(items, items.join(open_orders, "order_id"))


@query(
    "column_tests",
    f"""WITH {ITEMS}, d AS (SELECT order_id, order_item_id, count(*) AS n FROM items GROUP BY 1, 2),
    q AS (SELECT (SELECT sum(n - 1) FROM d) AS u,
      (SELECT sum(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) FROM items) AS k,
      (SELECT sum(CASE WHEN product_id IS NULL THEN 1 ELSE 0 END) FROM items) AS p,
      (SELECT sum(CASE WHEN total_item_value < 0 THEN 1 ELSE 0 END) FROM items) AS neg)
    SELECT 'unique:order_id,order_item_id' AS test, {big('u')} AS violations, u = 0 AS passed FROM q
    UNION ALL SELECT 'not_null:order_id', {big('k')}, k = 0 FROM q
    UNION ALL SELECT 'not_null:product_id', {big('p')}, p = 0 FROM q
    UNION ALL SELECT 'non_negative:total_item_value', {big('neg')}, neg = 0 FROM q""",
)
def column_tests(spark, sf):
    return tests(
        views.order_items(spark, sf),
        key=["order_id", "order_item_id"],
        not_null=["order_id", "product_id"],
        non_negative=["total_item_value"],
    )


# --- joins -----------------------------------------------------------------------------------


@query(
    "join_left_lookup",
    """WITH t AS (SELECT DISTINCT lower(p_type) AS name, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS english
      FROM part WHERE p_type <> 'PROMO')
    SELECT p_partkey AS product_id, lower(p_type) AS category_pt, english AS category_english
    FROM part LEFT JOIN t ON lower(p_type) = name""",
)
def join_left_lookup(spark, sf):
    part = table(spark, sf, "part")
    lookup = (
        part.filter(F.col("p_type") != "PROMO")
        .select(F.lower("p_type").alias("category_pt"), F.initcap("p_type").alias("category_english"))
        .distinct()
    )
    left = part.select(F.col("p_partkey").alias("product_id"), F.lower("p_type").alias("category_pt"))
    return left.join(lookup, "category_pt", "left").select("product_id", "category_pt", "category_english")


@query(
    "join_ref_probe",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_custkey IS NOT NULL AS customer_exists
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 53 <> 0) ON o_custkey = c_custkey""",
)
def join_ref_probe(spark, sf):
    from ..operators.integrity import probe

    parents = table(spark, sf, "customer").filter(F.col("c_custkey") % 53 != 0)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    return probe(orders, parents, {"customer_id": "c_custkey"}, "customer_exists")


@query(
    "join_ref_multi",
    """SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, strftime(o_orderdate, '%Y-%m') AS order_year_month,
    o_orderkey IS NOT NULL AS order_exists, p_partkey IS NOT NULL AS product_exists, s_suppkey IS NOT NULL AS seller_exists
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey
    LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 97 <> 0) ON l_partkey = p_partkey
    LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 31 <> 0) ON l_suppkey = s_suppkey""",
)
def join_ref_multi(spark, sf):
    from ..operators.integrity import probe

    items = views.order_items(spark, sf).select("order_id", "order_item_id", "product_id", "seller_id")
    orders = views.order_headers(spark, sf).filter(F.col("order_status") != "P")
    parts = views.products(spark, sf).filter(F.col("product_id") % 97 != 0)
    sellers = table(spark, sf, "supplier").filter(F.col("s_suppkey") % 31 != 0)
    out = probe(items, orders, {"order_id": "order_id"}, "order_exists", carry=["order_year_month"])
    out = probe(out, parts, {"product_id": "product_id"}, "product_exists")
    out = probe(out, sellers, {"seller_id": "s_suppkey"}, "seller_exists")
    return out.drop("product_id", "seller_id")


@query(
    "join_inner_header",
    f"WITH {LINES} SELECT order_id, order_item_id, customer_id, order_status, order_date_key, {dbl('total_item_value')} AS total_item_value FROM lines",
)
def join_inner_header(spark, sf):
    items = views.order_items(spark, sf).select("order_id", "order_item_id", "total_item_value")
    headers = views.order_headers(spark, sf).select("order_id", "customer_id", "order_status", "order_date_key")
    return marts.as_double(items.join(headers, "order_id"), "total_item_value")


@query(
    "join_star_lookup",
    f"""WITH {LINES} SELECT order_id, order_item_id, sha256(cast(c_custkey as varchar) || '||v1') AS customer_key,
    sha256(cast(p_partkey as varchar)) AS product_key, sha256(cast(s_suppkey as varchar)) AS seller_key FROM lines
    LEFT JOIN customer ON customer_id = c_custkey LEFT JOIN part ON product_id = p_partkey
    LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 31 <> 0) ON seller_id = s_suppkey""",
)
def join_star_lookup(spark, sf):
    from ..plans.gold import resolve_keys

    lines = views.order_items(spark, sf).join(views.order_headers(spark, sf), "order_id")
    lines = lines.select("order_id", "order_item_id", "customer_id", "product_id", "seller_id")
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), surrogate_key(F.col("c_custkey"), F.lit("v1")).alias("customer_key")
    )
    prod = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), surrogate_key("p_partkey").alias("product_key"))
    sell = (
        table(spark, sf, "supplier")
        .filter(F.col("s_suppkey") % 31 != 0)
        .select(F.col("s_suppkey").alias("seller_id"), surrogate_key("s_suppkey").alias("seller_key"))
    )
    out = resolve_keys(lines, {"customer_id": cust, "product_id": prod, "seller_id": sell})
    return out.select("order_id", "order_item_id", "customer_key", "product_key", "seller_key")


@query(
    "join_mart_inner",
    f"""WITH {ITEMS}, {PRODUCTS} SELECT order_id, order_item_id, product_id, category, {dbl('total_item_value')} AS total_item_value
    FROM items JOIN products USING (product_id)""",
)
def join_mart_inner(spark, sf):
    items = views.order_items(spark, sf).select("order_id", "order_item_id", "product_id", "total_item_value")
    return marts.as_double(items.join(views.products(spark, sf).select("product_id", "category"), "product_id"), "total_item_value")


@query(
    "join_orphans_anti",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 53 <> 0)""",
)
def join_orphans_anti(spark, sf):
    parents = table(spark, sf, "customer").filter(F.col("c_custkey") % 53 != 0).select(F.col("c_custkey").alias("customer_id"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    return orders.join(parents, "customer_id", "left_anti").select("order_id", "customer_id")


# --- simple projections over the marts ---------------------------------------------------------


@query(
    "line_amounts",
    f"""WITH {ITEMS} SELECT order_id, order_item_id, {dbl('item_price')} AS item_price, {dbl('freight_value')} AS freight_value,
    {dbl('total_item_value')} AS total_item_value FROM items""",
)
def line_amounts(spark, sf):
    out = views.order_items(spark, sf).select("order_id", "order_item_id", "item_price", "freight_value", "total_item_value")
    return marts.as_double(out, "item_price", "freight_value", "total_item_value")


@query(
    "surrogate_keys",
    """SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
    sha256(cast(l_orderkey as varchar) || '||' || cast(l_linenumber as varchar)) AS sales_fact_key,
    sha256(coalesce(CASE WHEN l_returnflag <> 'R' THEN l_returnflag END, chr(0)) || '||' || l_linestatus) AS status_key FROM lineitem""",
)
def surrogate_keys(spark, sf):
    li = table(spark, sf, "lineitem")
    flag = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        surrogate_key("l_orderkey", "l_linenumber").alias("sales_fact_key"),
        surrogate_key(flag, F.col("l_linestatus")).alias("status_key"),
    )


@query("date_key", "SELECT o_orderkey AS order_id, cast(strftime(o_orderdate, '%Y%m%d') as integer) AS order_date_key FROM orders")
def date_keys(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), date_key("o_orderdate").alias("order_date_key"))


@query(
    "staging_projection",
    f"""WITH {CUSTOMERS} SELECT sha256(cast(customer_id as varchar) || '||v1') AS customer_key, customer_id, customer_unique_id,
    state AS customer_state, true AS is_current FROM customers""",
)
def staging_projection(spark, sf):
    return views.customers(spark, sf).select(
        surrogate_key(F.col("customer_id"), F.lit("v1")).alias("customer_key"),
        "customer_id",
        "customer_unique_id",
        F.col("state").alias("customer_state"),
        F.lit(True).alias("is_current"),
    )


@query(
    "freight_ratio",
    f"""WITH {LINES} SELECT order_year_month, {dbl('sum(item_price)')} AS item_revenue, {dbl('sum(freight_value)')} AS freight_revenue,
    round({dbl('sum(freight_value)')} / {dbl('sum(total_item_value)')} * 100.0, 6) AS freight_share_pct FROM lines GROUP BY 1""",
)
def freight_ratio(spark, sf):
    out = marts.orders_with_revenue(views.order_items(spark, sf), views.order_headers(spark, sf))
    out = out.groupBy("order_year_month").agg(
        F.sum("product_revenue").alias("item_revenue"),
        F.sum("freight_revenue").alias("freight_revenue"),
        F.sum("gross_order_revenue").alias("g"),
    )
    share = F.round(ratio(F.col("freight_revenue"), F.col("g")) * 100.0, 6)
    out = out.withColumn("freight_share_pct", share).drop("g")
    return marts.as_double(out, "item_revenue", "freight_revenue")


@query(
    "contract_metrics",
    f"""WITH {ITEMS} SELECT {dbl('sum(total_item_value)')} AS total_gross_revenue, {dbl('sum(freight_value)')} AS total_freight_revenue,
    count(*) AS total_fact_rows, count(DISTINCT order_id) AS total_distinct_orders,
    {mean_money('sum(total_item_value)', 'count(DISTINCT order_id)')} AS average_order_value FROM items""",
)
def contract_metrics(spark, sf):
    from ..sources.contract import contract_metrics as metrics

    return metrics(views.order_items(spark, sf))
