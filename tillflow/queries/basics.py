"""Projections, predicates, top-k, set operations and scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import dates, numbers, text
from ..functions.keys import event_id, surrogate_key
from ..operators import select
from ..plans import marts, silver
from .registry import query, table
from .sqlbits import CUSTOMERS, HEADERS, ITEMS, LINES, PRODUCTS, SELLERS, big, dbl, pct_delta
from .silver import STATES_SQL, title

DUCK_EDGE = r"\A[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+\z"


# --- projections -------------------------------------------------------------------------------


@query(
    "normalize_text",
    f"""SELECT cast(c_custkey as varchar) AS customer_id, {title('n_name')} AS city, upper(c_mktsegment) AS state, lower(c_mktsegment) AS payment_type
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def normalize_text(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.trim(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("customer_id"),
        F.initcap(F.trim(F.concat(F.lower("n_name"), F.lit(" ")))).alias("city"),
        F.upper(F.trim(F.concat(F.lit(" "), F.lower("c_mktsegment")))).alias("state"),
        F.lower(F.trim("c_mktsegment")).alias("payment_type"),
    )


SPOILED = """CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN '' ELSE cast(cast(value as decimal(12,2)) as varchar) END"""


@query(
    "safe_typing",
    f"""WITH t AS (SELECT event_id, {SPOILED} AS v FROM events) SELECT event_id, try_cast(v as double) AS as_double,
    cast(try_cast(v as decimal(10,1)) as double) AS as_decimal,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE cast(event_id % 1000 as integer) END AS as_int FROM t""",
)
def safe_typing(spark, sf):
    key = F.col("event_id")
    value = F.when(key % 7 == 0, "n/a").when(key % 11 == 0, "").otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    number = F.when(key % 7 == 0, "12x").otherwise((key % 1000).cast("string"))
    return table(spark, sf, "events").select(
        "event_id",
        value.try_cast("double").alias("as_double"),
        value.try_cast("decimal(10,1)").cast("double").alias("as_decimal"),
        number.try_cast("int").alias("as_int"),
    )


@query(
    "parse_timestamps",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS purchased_at,
    o_orderkey % 13 <> 0 AS parsed FROM orders""",
)
def parse_timestamps(spark, sf):
    raw = F.when(F.col("o_orderkey") % 13 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", dates.TIMESTAMP_PATTERN)
    )
    parsed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), dates.parse_timestamp(raw).alias("ts"))
    return parsed.select("order_id", F.date_format("ts", dates.TIMESTAMP_PATTERN).alias("purchased_at"), F.col("ts").isNotNull().alias("parsed"))


@query(
    "derived_volume",
    """SELECT p_partkey AS product_id, cast(CASE WHEN p_partkey % 41 <> 0 THEN (p_size + 10) * (p_size + 2) * (p_size + 5) END as double) AS volume_cm3 FROM part""",
)
def derived_volume(spark, sf):
    size = F.col("p_size")
    length = F.when(F.col("p_partkey") % 41 == 0, F.lit(None)).otherwise(size + 10).cast(silver.DIMENSION)
    volume = silver.volume(length, (size + 2).cast(silver.DIMENSION), (size + 5).cast(silver.DIMENSION))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), volume.cast("double").alias("volume_cm3"))


@query(
    "category_fallback",
    """SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 5 = 0 THEN lower(p_brand) ELSE 'unclassified' END AS category FROM part""",
)
def category_fallback(spark, sf):
    english = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))
    original = F.when(F.col("p_partkey") % 5 == 0, F.lower("p_brand"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.coalesce(english, original, F.lit(silver.UNCLASSIFIED)).alias("category")
    )


@query(
    "order_features",
    """WITH d AS (SELECT l_orderkey, max(CASE WHEN l_linestatus = 'F' THEN l_shipdate END) AS delivered FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m') AS order_year_month, cast(datediff('day', o_orderdate, delivered) as integer) AS delivery_days,
    CASE WHEN delivered > o_orderdate + INTERVAL 30 DAY THEN true WHEN delivered IS NOT NULL THEN false END AS is_delayed
    FROM orders LEFT JOIN d ON o_orderkey = l_orderkey""",
)
def order_features(spark, sf):
    li = table(spark, sf, "lineitem")
    done = F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("timestamp"))
    delivered = li.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max(done).alias("delivered_at"))
    headers = views.order_headers(spark, sf).select("order_id", "purchased_at", "estimated_at")
    fields = silver.delivery_fields(F.col("purchased_at"), F.col("delivered_at"), F.col("estimated_at"))
    return headers.join(delivered, "order_id", "left").select("order_id", *[c.alias(a) for a, c in fields.items()])


@query("drop_columns", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def drop_columns(spark, sf):
    from ..operators.cleaning import drop_columns as drop

    return drop(table(spark, sf, "part"), ["p_size", "p_retailprice", "not_there"])


@query(
    "clean_numeric_text",
    """SELECT s_suppkey AS seller_id, CASE WHEN s_suppkey % 10 = 0 THEN 0.0::double ELSE s_acctbal END AS amount FROM supplier""",
)
def clean_numeric_text(spark, sf):
    key, amount = F.col("s_suppkey"), F.col("s_acctbal").cast("decimal(12,2)")
    raw = (
        F.when(key % 10 == 0, F.lit("n.a."))
        .when(key % 3 == 0, F.concat(F.lit("€ "), amount.cast("string")))
        .when(key % 3 == 1, F.concat(F.lit("$"), F.format_number(amount, 2)))
        .otherwise(F.concat(amount.cast("string"), F.lit(" %")))
    )
    return table(spark, sf, "supplier").select(key.alias("seller_id"), numbers.clean_numeric_text(raw).alias("amount"))


@query(
    "compact_metric",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN cast(o_totalprice as decimal(12,2)) * 10000
      WHEN o_orderkey % 5 = 1 THEN cast(o_totalprice as decimal(12,2)) * 10 WHEN o_orderkey % 5 = 2 THEN cast(o_totalprice as decimal(12,2))
      ELSE cast(o_orderkey % 1000 as decimal(12,2)) + 0.25 END::decimal(18,2) AS v FROM orders)
    SELECT o_orderkey AS order_id, CASE WHEN v >= 1000000000 THEN '$' || cast(v * 0.000000001::decimal(10,9) as decimal(18,2)) || 'B'
      WHEN v >= 1000000 THEN '$' || cast(v * 0.000001::decimal(10,9) as decimal(18,2)) || 'M'
      WHEN v >= 1000 THEN '$' || cast(v * 0.001::decimal(10,9) as decimal(18,1)) || 'K' ELSE '$' || v END AS label FROM t""",
)
def compact_metric(spark, sf):
    key, amount = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(12,2)")
    value = (
        F.when(key % 5 == 0, (amount * 10000).cast("decimal(18,2)"))
        .when(key % 5 == 1, (amount * 10).cast("decimal(18,2)"))
        .when(key % 5 == 2, amount.cast("decimal(18,2)"))
        .otherwise(((key % 1000).cast("decimal(12,2)") + F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,2)"))
    )
    return table(spark, sf, "orders").select(key.alias("order_id"), numbers.compact_metric(value).alias("label"))


# --- predicates --------------------------------------------------------------------------------


@query("pred_required", "SELECT doc_id FROM documents WHERE source <> 'src3' AND length(text) > 0 AND lang IS NOT NULL")
def pred_required(spark, sf):
    source = F.when(F.col("source") != "src3", F.col("source"))
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", source.alias("source"))
    return docs.filter(text.required("source") & text.required("text") & text.required("lang")).select("doc_id")


@query(
    "pred_domain",
    f"SELECT o_orderkey AS order_id, o_orderstatus IN ('F', 'P') AS status_known, list_contains({STATES_SQL}, substr(o_orderpriority, 3, 2)) AS state_known FROM orders",
)
def pred_domain(spark, sf):
    from ..raw import STATES

    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderstatus").isin("F", "P").alias("status_known"),
        F.substring("o_orderpriority", 3, 2).isin(STATES).alias("state_known"),
    )


@query(
    "pred_range",
    "SELECT l_orderkey AS order_id, l_linenumber AS order_item_id FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05 AND l_quantity >= 10 AND l_linenumber >= 1",
)
def pred_range(spark, sf):
    li = table(spark, sf, "lineitem")
    kept = li.filter(F.col("l_discount").between(0.02, 0.05) & (F.col("l_quantity") >= 10) & (F.col("l_linenumber") >= 1))
    return kept.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"))


@query(
    "pred_time_sequence",
    """SELECT l_orderkey AS order_id, l_linenumber AS order_item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderdate >= timestamp '1996-01-01' AND (l_shipdate IS NULL OR l_shipdate >= o_orderdate)""",
)
def pred_time_sequence(spark, sf):
    orders = table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    li = table(spark, sf, "lineitem")
    joined = li.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    kept = joined.filter(F.col("l_shipdate").isNull() | (F.col("l_shipdate") >= F.col("o_orderdate")))
    return kept.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"))


@query(
    "pred_null_semantics",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)
    SELECT event_id, (v IS NULL OR v >= 10) AS tolerant, coalesce(v >= 10, false) AS strict FROM t""",
)
def pred_null_semantics(spark, sf):
    from ..operators.rules import failed

    value = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    return table(spark, sf, "events").select(
        "event_id", (value.isNull() | (value >= 10)).alias("tolerant"), (~failed(value >= 10)).alias("strict")
    )


@query(
    "slicer_filter",
    f"""WITH {HEADERS}, {CUSTOMERS} SELECT order_id, segment, region FROM headers JOIN customers USING (customer_id)
    WHERE purchased_at >= timestamp '1996-03-01' AND purchased_at < timestamp '1998-01-01' AND segment IN ('BUILDING', 'MACHINERY') AND region IN ('ASIA', 'EUROPE')""",
)
def slicer_filter(spark, sf):
    orders = select.slicer(table(spark, sf, "orders"), date_range=("o_orderdate", "1996-03-01", "1997-12-31"))
    orders = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    people = select.slicer(views.customers(spark, sf), values={"segment": ["BUILDING", "MACHINERY"], "region": ["ASIA", "EUROPE"]})
    return orders.join(people, "customer_id").select("order_id", "segment", "region")


@query(
    "text_search",
    "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(lower(p_type), 'bolt')",
)
def text_search(spark, sf):
    return select.text_search(table(spark, sf, "part"), "BOLT").select("p_partkey", "p_name", "p_brand", "p_type")


@query(
    "segment_drill",
    f"""WITH {ITEMS}, {PRODUCTS}, t AS (SELECT * FROM items JOIN products USING (product_id))
    SELECT 'PROMO' AS segment, {dbl("sum(CASE WHEN category = 'PROMO' THEN total_item_value END)")} AS segment_total, {dbl('sum(total_item_value)')} AS overall_total,
    round(100.0 * {dbl("sum(CASE WHEN category = 'PROMO' THEN total_item_value END)")} / {dbl('sum(total_item_value)')}, 6) AS share_pct,
    count(CASE WHEN category = 'PROMO' THEN 1 END) AS segment_rows FROM t""",
)
def segment_drill(spark, sf):
    joined = views.order_items(spark, sf).join(views.products(spark, sf), "product_id")
    return select.segment_share(joined, "category", "PROMO", F.col("total_item_value"))


# --- top-k and selections ------------------------------------------------------------------------


@query(
    "topn_groups",
    f"""WITH {ITEMS}, t AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'Unspecified' ELSE p_brand END AS brand, item_price FROM items JOIN part ON product_id = p_partkey)
    SELECT brand, {dbl('sum(item_price)')} AS total FROM t GROUP BY 1 ORDER BY sum(item_price) DESC, brand LIMIT 8""",
)
def topn_groups(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("brand")
    )
    joined = views.order_items(spark, sf).select("product_id", "item_price").join(part, "product_id")
    return marts.as_double(select.top_groups(joined, "brand", F.col("item_price"), 8), "total")


@query(
    "topn_other",
    f"""WITH {ITEMS}, t AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'Unspecified' ELSE p_brand END AS brand, item_price FROM items JOIN part ON product_id = p_partkey),
    g AS (SELECT brand, sum(item_price) AS total FROM t WHERE item_price > 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, brand) AS rk FROM g)
    SELECT CASE WHEN rk <= 6 THEN brand ELSE 'Other' END AS brand, {dbl('sum(total)')} AS total FROM r GROUP BY 1""",
)
def topn_other(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).otherwise(F.lit(" ")).alias("brand")
    )
    joined = views.order_items(spark, sf).select("product_id", "item_price").join(part, "product_id")
    return marts.as_double(select.top_and_other(joined, "brand", F.col("item_price"), 6), "total")


@query("sort_limit", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def sort_limit(spark, sf):
    cols = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return select.sort_limit(cols, [F.col("c_acctbal").desc(), F.col("c_custkey")], 25)


@query(
    "top_transactions",
    """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey AS transaction_id, o_totalprice AS revenue, o_orderpriority AS category
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""",
)
def top_transactions(spark, sf):
    """The window only numbers the five rows that the take-ordered left."""
    from pyspark.sql import Window as W

    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("revenue"), F.col("o_orderpriority").alias("category")
    )
    order = [F.col("revenue").desc(), F.col("transaction_id")]
    head = select.sort_limit(orders, order, 5)
    return head.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint"))


@query(
    "top_contributor",
    f"""WITH {LINES}, {PRODUCTS}, {CUSTOMERS}, a AS (SELECT category, sum(total_item_value) AS v FROM lines JOIN products USING (product_id) GROUP BY 1),
    b AS (SELECT region, sum(total_item_value) AS v FROM lines JOIN customers USING (customer_id) GROUP BY 1)
    SELECT 'category' AS dimension, arg_max(category, v) AS leader, {dbl('max(v)')} AS value FROM a UNION ALL SELECT 'region', arg_max(region, v), {dbl('max(v)')} FROM b""",
)
def top_contributor(spark, sf):
    from ..operators.kpis import leader

    items = views.order_items(spark, sf)
    by_category = items.join(views.products(spark, sf), "product_id")
    by_region = marts.orders_with_revenue(items, views.order_headers(spark, sf)).join(views.customers(spark, sf), "customer_id")
    first = leader(by_category, "category", F.col("total_item_value"))
    second = leader(by_region, "region", F.col("gross_order_revenue"))
    return first.unionByName(second).select("dimension", "leader", F.col("value").cast("double").alias("value"))


@query(
    "xy_sample_corr",
    """WITH p AS (SELECT o_orderkey, o_totalprice AS x, o_custkey::double AS y FROM orders), s AS (SELECT * FROM p ORDER BY sha256(cast(o_orderkey as varchar)), o_orderkey LIMIT 2000)
    SELECT count(*) AS n, round(min(x), 2) AS min_x, round(max(x), 2) AS max_x, (SELECT count(*) FROM p) AS pairs, (SELECT round(corr(x, y), 6) FROM p) AS correlation FROM s""",
)
def xy_sample_corr(spark, sf):
    """The points to draw are a bounded sample; the correlation is that of all pairs."""
    orders, x, y = table(spark, sf, "orders"), F.col("o_totalprice"), F.col("o_custkey")
    whole = select.correlation(orders, x, y).select(F.struct("pairs", "correlation")).scalar()
    sample = select.scatter_sample(orders, "o_orderkey", x, y, 2000)
    drawn = sample.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("x"), 2).alias("min_x"),
        F.round(F.max("x"), 2).alias("max_x"),
    )
    return drawn.withColumn("_all", whole).select("n", "min_x", "max_x", F.col("_all.pairs").alias("pairs"), F.round("_all.correlation", 6).alias("correlation"))


@query("hash_sample")
def hash_sample(spark, sf):
    sample = select.hash_sample(table(spark, sf, "lineitem"), "l_orderkey", 10)
    return sample.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("sampled_rows"), F.sum("scale_factor").alias("estimated_rows")
    )


# --- set operations ------------------------------------------------------------------------------


@query("distinct_values", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL")
def distinct_values(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("value")).dropna().distinct().orderBy("value")


@query(
    "key_set_ops",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997)
    SELECT 'common' AS kind, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'removed', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    UNION ALL SELECT 'new', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
)
def key_set_ops(spark, sf):
    orders = table(spark, sf, "orders")

    def keys(year):
        return orders.filter(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("k"))

    a, b = keys(1996), keys(1997)
    parts = {"common": a.intersect(b), "removed": a.subtract(b), "new": b.subtract(a)}
    out = [df.select(F.lit(kind).alias("kind"), "k") for kind, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "replay_with_dups",
    """WITH d AS (SELECT * FROM events ORDER BY event_id LIMIT 10) SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM d""",
)
def replay_with_dups(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return events.unionAll(select.sort_limit(events, [F.col("event_id")], 10))


# --- scalar families ---------------------------------------------------------------------------


@query(
    "scalar_string",
    rf"""SELECT doc_id, length(regexp_replace(text, '{DUCK_EDGE}', '', 'g')) AS stripped_length, upper(lang) AS upper_lang, lower(source) AS lower_source,
    {title('lang')} AS title_lang, {title('source')} AS capital_source, lang || '|' || source AS joined, trim(lang || '  ') AS trimmed FROM documents""",
)
def scalar_string(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length(text.strip("text")).cast("bigint").alias("stripped_length"),
        F.upper("lang").alias("upper_lang"),
        F.lower("source").alias("lower_source"),
        F.initcap("lang").alias("title_lang"),
        text.capitalize("source").alias("capital_source"),
        F.concat_ws("|", "lang", "source").alias("joined"),
        F.trim(F.concat(F.col("lang"), F.lit("  "))).alias("trimmed"),
    )


EMAIL_ANY = r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"
#: Found in the same texts; one character at either end decides, so no run is walked from each of its places.
EMAIL_FOUND = r"[A-Za-z0-9_.-]@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]"


@query(
    "scalar_regex",
    rf"""SELECT doc_id, contains(text, '@') AS has_at, regexp_matches(text, '{EMAIL_ANY}') AS has_email,
    length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS alnum_length FROM documents""",
)
def scalar_regex(spark, sf):
    has_at = F.col("text").contains("@")
    return table(spark, sf, "documents").select(
        "doc_id",
        has_at.alias("has_at"),
        # A text without the sign needs no trial.
        (has_at & F.col("text").rlike(EMAIL_FOUND)).alias("has_email"),
        # Runs of other characters are one match each.
        F.length(F.regexp_replace("text", "[^a-zA-Z0-9]++", "")).cast("bigint").alias("alnum_length"),
    )


@query(
    "scalar_date",
    """SELECT o_orderkey AS order_id, cast(o_orderdate as date) AS day, cast(datediff('day', timestamp '1995-01-01', o_orderdate) as integer) AS days,
    cast(day(o_orderdate) as integer) AS dom, cast(dayofweek(o_orderdate) + 1 as integer) AS dow, cast(weekofyear(o_orderdate) as integer) AS woy,
    cast(quarter(o_orderdate) as integer) AS q, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month_name,
    cast(date_trunc('month', o_orderdate) as date) AS month_start, cast(date_trunc('week', o_orderdate) as date) AS week_start,
    year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter_label, 'W' || strftime(o_orderdate, '%W %Y') AS week_label FROM orders""",
)
def scalar_date(spark, sf):
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.to_date(day).alias("day"),
        F.datediff(day, F.lit("1995-01-01")).alias("days"),
        F.dayofmonth(day).alias("dom"),
        F.dayofweek(day).alias("dow"),
        F.weekofyear(day).alias("woy"),
        F.quarter(day).alias("q"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.trunc(day, "month").alias("month_start"),
        F.trunc(day, "week").alias("week_start"),
        dates.quarter_label(day).alias("quarter_label"),
        dates.period_label(F.to_date(day), "weekly").alias("week_label"),
    )


@query(
    "scalar_math",
    """SELECT l_orderkey AS order_id, l_linenumber AS item, round(l_quantity / 7.0, 6) AS r, round_even(l_quantity / 2.0, 0) AS half_even, abs(l_quantity - 25) AS distance,
    l_quantity BETWEEN 10 AND 20 AS between_10_20, greatest(5.0, least(40.0, l_quantity)) AS clipped, round((l_quantity - 25.5) / 14.43, 6) AS z FROM lineitem""",
)
def scalar_math(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("item"),
        F.round(q / 7.0, 6).alias("r"),
        F.bround(q / 2.0, 0).alias("half_even"),
        F.abs(q - 25).alias("distance"),
        q.between(10, 20).alias("between_10_20"),
        F.greatest(F.lit(5.0), F.least(F.lit(40.0), q)).alias("clipped"),
        F.round((q - 25.5) / 14.43, 6).alias("z"),
    )


@query(
    "pct_delta",
    f"""WITH t AS (SELECT l_orderkey AS order_id, l_linenumber AS item, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE l_quantity END AS a,
      CASE WHEN l_linenumber % 3 = 0 THEN 0.0 WHEN l_linenumber % 3 = 1 THEN -l_quantity ELSE l_discount * 100 END AS b FROM lineitem)
    SELECT order_id, item, round({pct_delta('a', 'b')}, 6) AS delta FROM t""",
)
def pct_delta_rows(spark, sf):
    a = F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity"))
    item = F.col("l_linenumber")
    b = F.when(item % 3 == 0, 0.0).when(item % 3 == 1, -F.col("l_quantity")).otherwise(F.col("l_discount") * 100)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), item.alias("item"), F.round(numbers.pct_delta(a, b), 6).alias("delta")
    )


@query(
    "scalar_conditional",
    """SELECT event_id, CASE WHEN value > 20 THEN 'high' WHEN value > 5 THEN 'mid' ELSE 'low' END AS level,
    coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'none') AS filled, (CASE WHEN event_id % 3 = 0 THEN event_type END) IS NULL AS is_missing,
    event_type IN ('click', 'view') AS browsing FROM events""",
)
def scalar_conditional(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("value") > 20, "high").when(F.col("value") > 5, "mid").otherwise("low").alias("level"),
        F.coalesce(kind, F.lit("none")).alias("filled"),
        kind.isNull().alias("is_missing"),
        F.col("event_type").isin("click", "view").alias("browsing"),
    )


@query(
    "scalar_hash",
    """SELECT event_id, sha256(cast(event_id as varchar) || '||' || cast(user_id as varchar)) AS id, sha256(props) AS payload_hash FROM events""",
)
def scalar_hash(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", event_id(F.col("event_id"), F.col("user_id")).alias("id"), F.sha2("props", 256).alias("payload_hash")
    )


@query(
    "scalar_array",
    """WITH t AS (SELECT event_id, list_filter([CASE WHEN value < 5 THEN 'low' END, CASE WHEN user_id % 2 = 0 THEN 'even' END, CASE WHEN event_type = 'error' THEN 'error' END],
      lambda x: x IS NOT NULL) AS a FROM events) SELECT event_id, cast(len(a) as integer) AS n, array_to_string(a, '; ') AS tags FROM t""",
)
def scalar_array(spark, sf):
    tags = F.array_compact(
        F.array(
            F.when(F.col("value") < 5, "low"), F.when(F.col("user_id") % 2 == 0, "even"), F.when(F.col("event_type") == "error", "error")
        )
    )
    return table(spark, sf, "events").select("event_id", F.size(tags).alias("n"), F.array_join(tags, "; ").alias("tags"))


@query(
    "scalar_json",
    """SELECT event_id, cast(json_extract(props, '$.k') as bigint) AS k, to_json({event_id: event_id, event_type: event_type})::varchar AS payload FROM events""",
)
def scalar_json(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("payload")
    )


@query(
    "scalar_stats",
    """SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS stddev,
    round(quantile_cont(value, 0.25), 6) AS p25, count(DISTINCT user_id) AS users, round(regr_slope(value, user_id), 6) AS slope, round(regr_intercept(value, user_id), 6) AS intercept
    FROM events GROUP BY event_type""",
)
def scalar_stats(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.median("value"), 6).alias("median"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.round(F.stddev_samp("value"), 6).alias("stddev"),
        F.round(F.percentile("value", 0.25), 6).alias("p25"),
        F.count_distinct("user_id").alias("users"),
        F.round(F.regr_slope("value", "user_id"), 6).alias("slope"),
        F.round(F.regr_intercept("value", "user_id"), 6).alias("intercept"),
    )
