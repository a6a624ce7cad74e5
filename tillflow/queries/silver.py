"""Quality firewall, silver entities, dimensions and the fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import raw
from ..operators import rules
from ..operators.reconcile import layer_account
from ..plans import gold, silver
from ..session import materialize
from .registry import query
from .sqlbits import FREIGHT, big, dbl, mean_money

STATES_SQL = "[" + ", ".join(f"'{s}'" for s in raw.STATES) + "]"
STATUSES_SQL = ", ".join(f"'{s}'" for s in silver.ORDER_STATUSES)
TS = "'%Y-%m-%d %H:%M:%S'"


def flagged_sql(name: str, source: str, conditions: list[tuple[str, str, str]]) -> str:
    ids = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{i}' END" for i, _, c in conditions)
    reasons = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{i}: {d}' END" for i, d, c in conditions)
    return (
        f"{name}_flagged AS (SELECT *, list_filter([{ids}], lambda x: x IS NOT NULL) AS ids, "
        f"list_filter([{reasons}], lambda x: x IS NOT NULL) AS reasons FROM {source}), "
        f"{name}_valid AS (SELECT * FROM {name}_flagged WHERE len(ids) = 0)"
    )


def title(expr: str) -> str:
    return f"upper(substr({expr}, 1, 1)) || lower(substr({expr}, 2))"


CAT = (
    """cat AS (SELECT lower(p_type) AS product_category_name,
      CASE WHEN p_type = 'SMALL' THEN '' ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS product_category_name_english
      FROM (SELECT DISTINCT p_type FROM part) WHERE p_type <> 'PROMO'), """
    + flagged_sql(
        "cat",
        "cat",
        [
            ("DQ001", "Category name required", "length(product_category_name) > 0"),
            ("DQ002", "English category name required", "length(product_category_name_english) > 0"),
        ],
    )
)

CUST = (
    f"""cust AS (SELECT cast(c_custkey as varchar) AS customer_id,
      CASE WHEN c_custkey % 89 = 0 THEN '' ELSE c_name END AS customer_unique_id,
      lpad(cast(c_custkey % 1000 as varchar), 5, '0') AS customer_zip_code_prefix,
      {title('n_name')} AS customer_city,
      CASE WHEN c_custkey % 53 = 0 THEN 'XX' ELSE {STATES_SQL}[c_nationkey + 1] END AS customer_state
      FROM customer JOIN nation ON c_nationkey = n_nationkey), """
    + flagged_sql(
        "cust",
        "cust",
        [
            ("DQ002", "Customer id required", "length(customer_id) > 0"),
            ("DQ002", "Customer unique id required", "length(customer_unique_id) > 0"),
            ("DQ011", "State code known", f"list_contains({STATES_SQL}, customer_state)"),
        ],
    )
)

SELL = (
    f"""sell AS (SELECT cast(s_suppkey as varchar) AS seller_id, lpad(cast(s_suppkey % 1000 as varchar), 5, '0') AS seller_zip_code_prefix,
      {title('n_name')} AS seller_city,
      CASE WHEN s_suppkey % 31 = 0 THEN '??' ELSE {STATES_SQL}[s_nationkey + 1] END AS seller_state
      FROM supplier JOIN nation ON s_nationkey = n_nationkey), """
    + flagged_sql(
        "sell",
        "sell",
        [
            ("DQ001", "Seller id required", "length(seller_id) > 0"),
            ("DQ011", "State code known", f"list_contains({STATES_SQL}, seller_state)"),
        ],
    )
)

PROD = (
    """prod0 AS (SELECT cast(p_partkey as varchar) AS product_id,
      CASE WHEN p_partkey % 29 <> 0 THEN lower(p_type) END AS product_category_name_pt,
      CASE WHEN p_partkey % 101 <> 0 THEN cast(length(p_name) as integer) END AS product_name_length,
      p_size * 3 AS product_description_length, cast(p_partkey % 5 as integer) AS product_photos_qty,
      CASE WHEN p_partkey % 97 = 0 THEN -1 WHEN p_partkey % 103 = 0 THEN NULL ELSE p_size * 100 END::decimal(10,2) AS product_weight_g,
      (CASE WHEN p_partkey % 41 <> 0 THEN (p_size + 10) * (p_size + 2) * (p_size + 5) END)::decimal(12,2) AS product_volume_cm3
      FROM part), prod AS (SELECT prod0.*, product_category_name_english,
      coalesce(product_category_name_english, product_category_name_pt, 'unclassified') AS product_category_name
      FROM prod0 LEFT JOIN cat_valid ON product_category_name_pt = cat_valid.product_category_name), """
    + flagged_sql(
        "prod",
        "prod",
        [
            ("DQ003", "Product id required", "length(product_id) > 0"),
            ("DQ004", "Weight not negative", "(product_weight_g IS NULL OR product_weight_g >= 0)"),
        ],
    )
)

GEO = (
    f"""geo AS (SELECT lpad(cast(c_custkey % 50 as varchar), 5, '0') AS geolocation_zip_code_prefix,
      ((c_custkey * 37) % 4300 - 3600) / 100.0::double AS geolocation_lat, ((c_custkey * 53) % 4700 - 7600) / 100.0::double AS geolocation_lng,
      {title('n_name')} AS geolocation_city,
      CASE WHEN c_custkey % 67 = 0 THEN '' ELSE {STATES_SQL}[c_nationkey + 1] END AS geolocation_state
      FROM customer JOIN nation ON c_nationkey = n_nationkey), """
    + flagged_sql(
        "geo",
        "geo",
        [
            ("DQ011", "State code known", f"list_contains({STATES_SQL}, geolocation_state)"),
            ("DQ004", "Latitude in bounds", "geolocation_lat BETWEEN -35.0 AND 6.0"),
            ("DQ004", "Longitude in bounds", "geolocation_lng BETWEEN -75.0 AND -30.0"),
        ],
    )
    + """, geo_city AS (SELECT geolocation_zip_code_prefix AS z, geolocation_state AS st, geolocation_city AS city, count(*) AS n
      FROM geo_valid GROUP BY 1, 2, 3),
      centroid AS (SELECT geolocation_zip_code_prefix, geolocation_state,
      (SELECT city FROM geo_city WHERE z = geolocation_zip_code_prefix AND st = geolocation_state ORDER BY n DESC, city LIMIT 1) AS geolocation_city,
      round(avg(geolocation_lat), 6) AS latitude, round(avg(geolocation_lng), 6) AS longitude, count(*) AS _coordinate_samples_count
      FROM geo_valid GROUP BY 1, 2)"""
)

ORD = (
    """ord_raw AS (SELECT *, unnest(CASE WHEN o_orderkey % 97 = 0 THEN [0, 1] ELSE [0] END) AS cp FROM orders),
    ord_b AS (SELECT *, CASE WHEN o_orderkey % 89 = 0 THEN cast(o_orderdate as date) ELSE cast(o_orderdate + INTERVAL 252 MONTH as date) END AS bought,
      CASE WHEN o_orderkey % 71 = 0 THEN -3 ELSE cast(o_orderkey % 45 as integer) END AS days FROM ord_raw),
    ord_c AS (SELECT CASE WHEN o_orderkey % 211 = 0 THEN '' ELSE cast(o_orderkey as varchar) END AS order_id,
      CASE WHEN o_orderkey % 151 <> 0 THEN cast(o_custkey as varchar) END AS customer_id,
      CASE WHEN cp = 1 THEN 'canceled' WHEN o_orderkey % 61 = 0 THEN 'lost' WHEN o_orderstatus = 'P' THEN 'shipped'
        WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'created' END AS order_status,
      CASE WHEN o_orderkey % 83 <> 0 THEN cast(bought as timestamp) END AS purchased,
      CASE WHEN o_orderstatus <> 'O' THEN cast(bought + days as timestamp) END AS delivered,
      cast(bought + 30 as timestamp) AS estimated, o_orderkey * 2 + cp AS line FROM ord_b),
    ord_d AS (SELECT *, row_number() OVER (PARTITION BY order_id, CASE WHEN order_id = '' THEN line END ORDER BY line) AS rn FROM ord_c),
    ord AS (SELECT ord_d.*, strftime(purchased, '%Y-%m') AS order_year_month, cast(datediff('day', purchased, delivered) as integer) AS delivery_days,
      CASE WHEN delivered > estimated THEN true WHEN delivered IS NOT NULL THEN false END AS is_delayed,
      cv.customer_id IS NOT NULL AS customer_exists
      FROM ord_d LEFT JOIN cust_valid cv ON ord_d.customer_id = cv.customer_id WHERE rn = 1), """
    + flagged_sql(
        "ord",
        "ord",
        [
            ("DQ001", "Order id required", "length(order_id) > 0"),
            ("DQ002", "Customer id required", "length(customer_id) > 0"),
            ("DQ007", "Order status known", f"order_status IN ({STATUSES_SQL})"),
            ("DQ008", "Purchase time valid", "purchased >= timestamp '2016-01-01'"),
            ("DQ009", "Delivered after purchase", "(delivered IS NULL OR delivered >= purchased)"),
            ("DQ010", "Customer exists", "customer_exists"),
        ],
    )
)

ITEM = (
    f"""item_c AS (SELECT cast(l_orderkey as varchar) AS order_id, CASE WHEN l_partkey % 89 = 0 THEN 0 ELSE l_linenumber END AS order_item_id,
      cast(l_partkey as varchar) AS product_id, cast(l_suppkey as varchar) AS seller_id, l_shipdate AS shipping_limit_date,
      (CASE WHEN l_partkey % 79 = 0 THEN -1 ELSE 1 END * cast(l_extendedprice as decimal(12,2)))::decimal(12,2) AS price,
      CASE WHEN l_suppkey % 37 <> 0 THEN {FREIGHT} END AS freight_value FROM lineitem),
    item_d AS (SELECT *, cast(price + freight_value as decimal(12,2)) AS total_item_amount, row_number() OVER (PARTITION BY order_id, order_item_id
      ORDER BY product_id, seller_id, shipping_limit_date, price, freight_value NULLS LAST) AS rn FROM item_c),
    item AS (SELECT item_d.*, ov.order_year_month, ov.order_id IS NOT NULL AS o_ok, pv.product_id IS NOT NULL AS p_ok, sv.seller_id IS NOT NULL AS s_ok
      FROM item_d LEFT JOIN ord_valid ov ON item_d.order_id = ov.order_id LEFT JOIN prod_valid pv ON item_d.product_id = pv.product_id
      LEFT JOIN sell_valid sv ON item_d.seller_id = sv.seller_id WHERE item_d.rn = 1), """
    + flagged_sql(
        "item",
        "item",
        [
            ("DQ001", "Order id required", "order_id IS NOT NULL"),
            ("DQ003", "Product id required", "product_id IS NOT NULL"),
            ("DQ004", "Price not negative", "price >= 0"),
            ("DQ005", "Freight not negative", "freight_value >= 0"),
            ("DQ006", "Item number from 1", "order_item_id >= 1"),
            ("DQ010", "Order exists", "o_ok"),
            ("DQ010", "Product exists", "p_ok"),
            ("DQ010", "Seller exists", "s_ok"),
        ],
    )
)

PAY = (
    """pay AS (SELECT cast(event_id as varchar) AS order_id, 1 AS payment_sequential,
      ['credit_card', 'boleto', 'voucher', 'debit_card'][user_id % 4 + 1] AS payment_type,
      cast(user_id % 12 - 1 as integer) AS payment_installments,
      CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN -(cast(value as decimal(12,2)) + 1) ELSE cast(value as decimal(12,2)) END::decimal(12,2) AS payment_value,
      ov.order_id IS NOT NULL AS o_ok FROM events LEFT JOIN ord_valid ov ON cast(event_id as varchar) = ov.order_id WHERE event_type = 'purchase'), """
    + flagged_sql(
        "pay",
        "pay",
        [
            ("DQ001", "Order id required", "order_id IS NOT NULL"),
            ("DQ004", "Payment not negative", "payment_value >= 0"),
            ("DQ006", "Installments not negative", "payment_installments >= 0"),
            ("DQ010", "Order exists", "o_ok"),
        ],
    )
)

REV = (
    """rev AS (SELECT cast(d.doc_id as varchar) AS review_id, cast(d.doc_id * 3 as varchar) AS order_id,
      cast(n_chars % 6 + coalesce(quality, 0) as integer) AS review_score, source AS review_comment_title,
      trim(d.text, ' ') AS review_comment_message, ov.order_id IS NOT NULL AS o_ok
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN ord_valid ov ON cast(d.doc_id * 3 as varchar) = ov.order_id), """
    + flagged_sql(
        "rev",
        "rev",
        [
            ("DQ001", "Review and order id required", "review_id IS NOT NULL AND order_id IS NOT NULL"),
            ("DQ012", "Score from 1 to 5", "review_score BETWEEN 1 AND 5"),
            ("DQ010", "Order exists", "o_ok"),
        ],
    )
)

BASE = f"WITH {CAT}, {CUST}, {SELL}, {PROD}, {ORD}"
ITEMS_BASE = f"{BASE}, {ITEM}"


def lake_of(spark, sf):
    """Silver frames of one data set as lazy plans."""
    return silver.Silver(lambda entity: getattr(raw, entity)(spark, sf))


def settled_lake(spark, sf):
    """Like :func:`lake_of`, with the parents that several children need written once."""
    def settle(entity, frame):
        return materialize(frame, entity, free_shuffles=True) if entity in ("customers", "products", "sellers", "orders") else frame

    return silver.Silver(lambda entity: getattr(raw, entity)(spark, sf), settle)


def text_time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("silver_category", f"WITH {CAT} SELECT product_category_name, product_category_name_english FROM cat_valid")
def silver_category(spark, sf):
    return lake_of(spark, sf).valid("categories")


@query(
    "silver_customers",
    f"WITH {CUST} SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state FROM cust_valid",
)
def silver_customers(spark, sf):
    return lake_of(spark, sf).valid("customers")


@query("silver_sellers", f"WITH {SELL} SELECT seller_id, seller_zip_code_prefix, seller_city, seller_state FROM sell_valid")
def silver_sellers(spark, sf):
    return lake_of(spark, sf).valid("sellers")


@query(
    "silver_products",
    f"""WITH {CAT}, {PROD} SELECT product_id, product_category_name, product_category_name_pt, product_category_name_english,
    product_name_length, product_description_length, product_photos_qty, {dbl('product_weight_g')} AS product_weight_g,
    {dbl('product_volume_cm3')} AS product_volume_cm3 FROM prod_valid""",
)
def silver_products(spark, sf):
    return lake_of(spark, sf).valid("products").select(
        "product_id",
        "product_category_name",
        "product_category_name_pt",
        "product_category_name_english",
        "product_name_length",
        "product_description_length",
        "product_photos_qty",
        F.col("product_weight_g").cast("double").alias("product_weight_g"),
        F.col("product_volume_cm3").cast("double").alias("product_volume_cm3"),
    )


@query("silver_geo", f"WITH {GEO} SELECT * FROM centroid")
def silver_geo(spark, sf):
    return silver.centroids(lake_of(spark, sf).valid("geolocation"))


@query("geo_centroid", f"WITH {GEO} SELECT geolocation_zip_code_prefix, geolocation_state, geolocation_city, latitude, longitude, _coordinate_samples_count AS samples FROM centroid")
def geo_centroid(spark, sf):
    out = silver.centroids(lake_of(spark, sf).valid("geolocation"))
    return out.withColumnRenamed("_coordinate_samples_count", "samples")


@query(
    "silver_orders",
    f"""WITH {CUST}, {ORD} SELECT order_id, customer_id, order_status, strftime(purchased, {TS}) AS order_purchase_timestamp,
    strftime(delivered, {TS}) AS order_delivered_customer_date, strftime(estimated, {TS}) AS order_estimated_delivery_date,
    order_year_month, delivery_days, is_delayed FROM ord_valid""",
)
def silver_orders(spark, sf):
    return lake_of(spark, sf).valid("orders").select(
        "order_id",
        "customer_id",
        "order_status",
        text_time("order_purchase_timestamp"),
        text_time("order_delivered_customer_date"),
        text_time("order_estimated_delivery_date"),
        "order_year_month",
        "delivery_days",
        "is_delayed",
    )


@query(
    "silver_items",
    f"""{ITEMS_BASE} SELECT order_id, order_item_id, product_id, seller_id, {dbl('price')} AS price, {dbl('freight_value')} AS freight_value,
    {dbl('total_item_amount')} AS total_item_amount, order_year_month FROM item_valid""",
)
def silver_items(spark, sf):
    out = lake_of(spark, sf).valid("order_items").drop("shipping_limit_date")
    return out.withColumns({c: F.col(c).cast("double") for c in ("price", "freight_value", "total_item_amount")})


@query(
    "silver_payments",
    f"""WITH {CUST}, {ORD}, {PAY} SELECT order_id, payment_sequential, payment_type, payment_installments, {dbl('payment_value')} AS payment_value FROM pay_valid""",
)
def silver_payments(spark, sf):
    out = lake_of(spark, sf).valid("payments")
    return out.withColumn("payment_value", F.col("payment_value").cast("double"))


@query(
    "silver_reviews",
    f"""WITH {CUST}, {ORD}, {REV} SELECT review_id, order_id, review_score, review_comment_title, review_comment_message FROM rev_valid""",
)
def silver_reviews(spark, sf):
    return lake_of(spark, sf).valid("reviews")


# --- firewall --------------------------------------------------------------------------------


@query("dq_split", f"WITH {CUST}, {ORD} SELECT order_id, len(ids) = 0 AS is_valid, array_to_string(ids, '; ') AS failed_rules FROM ord_flagged")
def dq_split(spark, sf):
    flagged = lake_of(spark, sf).flagged("orders")
    return flagged.select("order_id", (F.size(rules.IDS) == 0).alias("is_valid"), F.array_join(rules.IDS, "; ").alias("failed_rules"))


@query(
    "dq_quarantine",
    f"""WITH {CUST}, q AS (SELECT *, to_json({{customer_id: customer_id, customer_unique_id: customer_unique_id,
      customer_zip_code_prefix: customer_zip_code_prefix, customer_city: customer_city, customer_state: customer_state}})::varchar AS raw_payload
      FROM cust_flagged WHERE len(ids) > 0)
    SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state,
    sha256('silver_customers||batch_1||' || raw_payload) AS _quarantine_id, 'silver_customers' AS _source_entity,
    array_to_string(ids, '; ') AS _dq_rule_id, array_to_string(reasons, '; ') AS _dq_reason,
    '2024-01-31T00:00:00Z' AS _quarantine_timestamp, '2024-01-31' AS _rejection_date, 'batch_1' AS _processing_batch_id, raw_payload FROM q""",
)
def dq_quarantine(spark, sf):
    flagged = lake_of(spark, sf).flagged("customers")
    return rules.quarantine(flagged, "silver_customers", "batch_1", "2024-01-31T00:00:00Z")


def metrics_sql(entity: str, name: str) -> str:
    bad = f"(SELECT count(*) FROM {name}_flagged WHERE len(ids) > 0)"
    n = f"(SELECT count(*) FROM {name}_flagged)"
    return f"SELECT '{entity}' AS entity, {n} AS input_count, {n} - {bad} AS valid_count, {bad} AS quarantined_count"


def rate_sql(digits: int) -> str:
    scale = 10**digits
    return f"(2 * quarantined_count * 100 * {scale} + input_count) // (2 * input_count) / {scale}.0::double"


@query("dq_metrics", f"WITH {CUST}, {ORD}, m AS ({metrics_sql('orders', 'ord')}) SELECT *, {rate_sql(2)} AS quarantine_pct FROM m")
def dq_metrics(spark, sf):
    return rules.metrics(lake_of(spark, sf).flagged("orders"), "orders")


@query(
    "dq_rule_counts",
    f"""WITH {CUST}, {ORD} SELECT split_part(reason, ':', 1) AS rule_id, reason, count(*) AS violations
    FROM (SELECT unnest(reasons) AS reason FROM ord_flagged) GROUP BY 1, 2""",
)
def dq_rule_counts(spark, sf):
    return rules.rule_counts(lake_of(spark, sf).flagged("orders"))


ENTITIES = {
    "categories": "cat",
    "customers": "cust",
    "sellers": "sell",
    "geolocation": "geo",
    "products": "prod",
    "orders": "ord",
    "order_items": "item",
    "payments": "pay",
    "reviews": "rev",
}


@query(
    "dq_report",
    f"{ITEMS_BASE}, {GEO}, {PAY}, {REV}, m AS ({' UNION ALL '.join(metrics_sql(e, n) for e, n in ENTITIES.items())}) "
    f"SELECT *, {rate_sql(2)} AS quarantine_pct FROM m UNION ALL SELECT *, {rate_sql(4)} AS quarantine_pct FROM "
    f"(SELECT 'TOTAL' AS entity, {big('sum(input_count)')} AS input_count, {big('sum(valid_count)')} AS valid_count, {big('sum(quarantined_count)')} AS quarantined_count FROM m)",
)
def dq_report(spark, sf):
    lake = settled_lake(spark, sf)
    return rules.report([rules.metrics(lake.flagged(e), e) for e in ENTITIES])


@query(
    "dq_gates",
    f"""WITH {CUST}, {ORD}, m AS ({metrics_sql('orders', 'ord')}), v AS (SELECT {rate_sql(2)} AS rate, input_count, input_count - valid_count - quarantined_count AS variance FROM m)
    SELECT 'quarantine_pct' AS gate, rate AS value, 1.0::double AS "limit", rate <= 1.0 AS passed FROM v
    UNION ALL SELECT 'input_count', input_count::double, 1.0, input_count >= 1 FROM v
    UNION ALL SELECT 'row_variance', variance::double, 0.0, variance = 0 FROM v""",
)
def dq_gates(spark, sf):
    """Rows are counted where they are flagged and again in what is stored as valid and as rejected."""
    landed = raw.orders(spark, sf)
    flagged = materialize(lake_of(spark, sf).flagged("orders"), "gate-flagged")
    valid = materialize(rules.valid(flagged), "gate-valid")
    rejected = materialize(rules.quarantine(flagged, "silver_orders", "batch", "2024-02-01 00:00:00"), "gate-rejected")
    account = layer_account("orders", landed, flagged, valid, rejected)
    counts = rules.metrics(flagged, "orders").withColumn("row_variance", account.select("variance").scalar())
    return rules.gates(counts, {"quarantine_pct": ("max", 1.0), "input_count": ("min", 1), "row_variance": ("equal", 0)})


# --- dimensions and fact -----------------------------------------------------------------------


@query(
    "dim_date",
    """WITH d AS (SELECT cast(unnest(generate_series(date_trunc('year', (SELECT min(o_orderdate) FROM orders))::timestamp,
      date_trunc('year', (SELECT max(o_orderdate) FROM orders))::timestamp + INTERVAL 12 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) as date) AS full_date)
    SELECT full_date, cast(strftime(full_date, '%Y%m%d') as integer) AS date_key, cast(day(full_date) as integer) AS day_of_month,
    cast(dayofweek(full_date) + 1 as integer) AS day_of_week, dayname(full_date) AS day_name, cast(weekofyear(full_date) as integer) AS week_of_year,
    cast(month(full_date) as integer) AS month_number, monthname(full_date) AS month_name, cast(quarter(full_date) as integer) AS quarter,
    cast(year(full_date) as integer) AS year, dayofweek(full_date) IN (0, 6) AS is_weekend FROM d""",
)
def dim_date(spark, sf):
    from ..views import load

    return gold.calendar(gold.whole_years(load(spark, sf, "orders"), "o_orderdate"))


@query(
    "dim_location",
    f"""WITH {GEO} SELECT sha256(geolocation_zip_code_prefix || '||' || geolocation_state) AS location_key, geolocation_zip_code_prefix AS zip_code_prefix,
    geolocation_city AS city, geolocation_state AS state, latitude, longitude, _coordinate_samples_count AS coordinate_samples_count FROM centroid""",
)
def dim_location(spark, sf):
    return gold.dim_location(silver.centroids(lake_of(spark, sf).valid("geolocation")))


@query(
    "dim_customer",
    f"""WITH {CUST} SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state,
    sha256(customer_id || '||v1') AS customer_key, sha256(customer_zip_code_prefix || '||' || customer_state) AS location_key,
    true AS is_current, '2016-01-01 00:00:00' AS effective_start_date, '9999-12-31 23:59:59' AS effective_end_date FROM cust_valid""",
)
def dim_customer(spark, sf):
    out = gold.dim_customer(lake_of(spark, sf).valid("customers"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("effective_start_date", "effective_end_date")})


@query(
    "dim_product",
    f"""WITH {CAT}, {PROD} SELECT sha256(product_id) AS product_key, product_id, product_category_name, product_category_name_english,
    {dbl('product_volume_cm3')} AS product_volume_cm3 FROM prod_valid""",
)
def dim_product(spark, sf):
    return gold.dim_product(lake_of(spark, sf).valid("products")).select(
        "product_key",
        "product_id",
        "product_category_name",
        "product_category_name_english",
        F.col("product_volume_cm3").cast("double").alias("product_volume_cm3"),
    )


@query(
    "dim_seller",
    f"""WITH {SELL} SELECT seller_id, seller_zip_code_prefix, seller_city, seller_state, sha256(seller_id) AS seller_key,
    sha256(seller_zip_code_prefix || '||' || seller_state) AS location_key FROM sell_valid""",
)
def dim_seller(spark, sf):
    return gold.dim_seller(lake_of(spark, sf).valid("sellers"))


def build_fact(lake):
    """The fact from items written once: what their checks shuffled is gone from disk when their keys are looked up."""
    return gold.fact_sales(
        materialize(lake.valid("order_items").select(*gold.ITEM_COLUMNS), "items", free_shuffles=True),
        lake.valid("orders"),
        gold.dim_customer(lake.valid("customers")),
        gold.dim_product(lake.valid("products")),
        gold.dim_seller(lake.valid("sellers")),
        "2024-02-01 00:00:00",
    )


FACT = """fact AS (SELECT sha256(i.order_id || '||' || cast(i.order_item_id as varchar)) AS sales_fact_key, i.order_id, i.order_item_id,
  sha256(c.customer_id || '||v1') AS customer_key, sha256(p.product_id) AS product_key, sha256(s.seller_id) AS seller_key,
  cast(strftime(purchased, '%Y%m%d') as integer) AS order_date_key,
  sha256(customer_zip_code_prefix || '||' || customer_state) AS location_key, order_status, purchased, delivered, estimated, delivery_days, is_delayed,
  1 AS order_item_quantity, price AS item_price, freight_value, price AS gross_item_value, cast(price + freight_value as decimal(12,2)) AS total_item_value,
  i.order_year_month FROM item_valid i JOIN ord_valid o ON i.order_id = o.order_id LEFT JOIN cust_valid c ON o.customer_id = c.customer_id
  LEFT JOIN prod_valid p ON i.product_id = p.product_id LEFT JOIN sell_valid s ON i.seller_id = s.seller_id)"""


@query(
    "fact_sales",
    f"""{ITEMS_BASE}, {FACT} SELECT sales_fact_key, order_id, order_item_id, customer_key, product_key, seller_key, order_date_key, location_key, order_status,
    strftime(purchased, {TS}) AS order_purchase_timestamp, strftime(delivered, {TS}) AS order_delivered_customer_date,
    strftime(estimated, {TS}) AS order_estimated_delivery_date, delivery_days, is_delayed, order_item_quantity, {dbl('item_price')} AS item_price,
    {dbl('freight_value')} AS freight_value, {dbl('gross_item_value')} AS gross_item_value, {dbl('total_item_value')} AS total_item_value, order_year_month, '2024-02-01 00:00:00' AS _processed_at FROM fact""",
)
def fact_sales(spark, sf):
    out = build_fact(settled_lake(spark, sf))
    times = ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date", "_processed_at")
    amounts = ("item_price", "freight_value", "gross_item_value", "total_item_value")
    return out.withColumns({**{c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times}, **{c: F.col(c).cast("double") for c in amounts}})


@query(
    "fact_metrics",
    f"""{ITEMS_BASE}, {FACT} SELECT count(*) AS fact_row_count, count(DISTINCT sales_fact_key) AS distinct_fact_keys,
    count(*) - count(DISTINCT sales_fact_key) AS grain_violations_count, count(DISTINCT order_id) AS total_orders_count,
    {big('sum(order_item_quantity)')} AS total_units_sold, {dbl('sum(item_price)')} AS total_item_revenue, {dbl('sum(freight_value)')} AS total_freight_revenue,
    {dbl('sum(total_item_value)')} AS total_gross_revenue, {mean_money('sum(total_item_value)', 'count(DISTINCT order_id)')} AS average_order_value_aov,
    {big('sum(CASE WHEN customer_key IS NULL THEN 1 ELSE 0 END)')} AS orphan_customer_keys, {big('sum(CASE WHEN product_key IS NULL THEN 1 ELSE 0 END)')} AS orphan_product_keys,
    {big('sum(CASE WHEN seller_key IS NULL THEN 1 ELSE 0 END)')} AS orphan_seller_keys FROM fact""",
)
def fact_metrics(spark, sf):
    return gold.fact_metrics(build_fact(settled_lake(spark, sf)))


@query(
    "scd2_history",
    """WITH s AS (SELECT o_custkey AS customer_id, o_orderdate AS changed_at, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1, 2),
    c AS (SELECT *, lag(priority) OVER w AS before FROM s WINDOW w AS (PARTITION BY customer_id ORDER BY changed_at)),
    v AS (SELECT *, lead(changed_at) OVER w AS nxt FROM c WHERE before IS NULL OR before <> priority WINDOW w AS (PARTITION BY customer_id ORDER BY changed_at))
    SELECT customer_id, priority, nxt IS NULL AS is_current, strftime(changed_at, '%Y-%m-%d %H:%M:%S') AS effective_start_date,
    coalesce(strftime(nxt, '%Y-%m-%d %H:%M:%S'), '9999-12-31 23:59:59') AS effective_end_date FROM v""",
)
def scd2_history(spark, sf):
    """Priority of a customer as stated by each order: a new version whenever it changes."""
    from ..views import order_headers

    states = order_headers(spark, sf).select(
        "customer_id", "order_id", F.col("order_priority").alias("priority"), F.col("purchased_at").alias("changed_at")
    )
    unique = gold.last_state(states, "customer_id", "changed_at", "order_id", ["priority"])
    out = gold.scd2(unique, "customer_id", ["priority"], "changed_at", F.trunc("changed_at", "month"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("effective_start_date", "effective_end_date")})
