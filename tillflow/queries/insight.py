"""Schema inference, KPIs, insight facts, comparison and drill-down."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import compare, drill, kpis, profile, schema_infer
from ..operators import timeseries as ts
from ..session import materialize
from . import quality as dirty_queries
from .quality import DIRTY, SCORE
from .registry import query, table
from .sqlbits import CUSTOMERS, HEADERS, ITEMS, LINES, PRODUCTS, big, dbl, pct_delta
from .trends import HALF

RETAIL = f"""{LINES}, {CUSTOMERS}, {PRODUCTS}, retail AS (SELECT order_id, purchased_at AS order_date, customer_id, product_name, category, region, quantity,
  total_item_value AS revenue, item_price - freight_value AS profit, order_status AS status FROM lines JOIN customers USING (customer_id) JOIN products USING (product_id))"""

# --- schema inference -------------------------------------------------------------------------

# Types worked out by hand from the rules, per column of the tables looked at.
TYPES = {
    "orders": {
        "o_orderkey": "id", "o_custkey": "id", "o_orderstatus": "categorical", "o_totalprice": "currency", "o_orderdate": "date", "o_orderpriority": "categorical",
    },
    "customer": {"c_custkey": "id", "c_name": "text", "c_nationkey": "id", "c_acctbal": "float", "c_mktsegment": "categorical"},
    "events": {"event_id": "id", "ts": "datetime", "user_id": "id", "event_type": "categorical", "value": "float", "props": "categorical"},
    "documents": {"doc_id": "id", "text": "text", "lang": "categorical", "source": "categorical", "n_chars": "integer"},
    "lineitem": {
        "l_orderkey": "id", "l_partkey": "id", "l_suppkey": "id", "l_linenumber": "integer", "l_quantity": "integer", "l_extendedprice": "currency",
        "l_discount": "percentage", "l_tax": "float", "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "date",
    },
}
BASE = {"currency": "numeric", "percentage": "numeric", "integer": "numeric", "float": "numeric", "date": "date", "datetime": "date", "categorical": "categorical", "id": "id", "text": "text"}


def typed_sql(tables: list[str], fields) -> str:
    return " UNION ALL ".join(fields(t, c, k) for t in tables for c, k in TYPES[t].items())


@query(
    "semantic_types",
    typed_sql(
        ["orders", "customer", "events", "documents"],
        lambda t, c, k: f"SELECT '{t}' AS table_name, '{c}' AS \"column\", '{k}' AS fine_type, '{BASE[k]}' AS base_type, count(DISTINCT {c}) AS unique_count FROM {t}",
    ),
)
def semantic_types(spark, sf):
    parts = []
    for name in ("orders", "customer", "events", "documents"):
        rows = schema_infer.catalog(table(spark, sf, name))
        parts.append(rows.select(F.lit(name).alias("table_name"), "column", "fine_type", "base_type", "unique_count"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "column_catalog",
    typed_sql(
        ["lineitem"],
        lambda t, c, k: f"""SELECT '{c}' AS "column", '{k}' AS fine_type, '{BASE[k]}' AS base_type, count(*) - count({c}) AS null_count,
        CASE WHEN count(DISTINCT {c}) / count(*)::double > 0.5 THEN 'high' WHEN count(DISTINCT {c}) > 20 THEN 'medium' ELSE 'low' END AS cardinality, count(DISTINCT {c}) AS unique_count FROM {t}""",
    ),
)
def column_catalog(spark, sf):
    out = schema_infer.catalog(table(spark, sf, "lineitem"))
    return out.select("column", "fine_type", "base_type", "null_count", "cardinality", "unique_count")


SIMPLE = {
    "orders": {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderdate": "date", "o_orderpriority": "categorical"},
    "events": {"event_id": "id", "ts": "date", "user_id": "id", "event_type": "categorical", "value": "numeric", "props": "categorical"},
}


@query(
    "semantic_types_simple",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", '{k}' AS semantic_type, count(DISTINCT {c}) AS unique_count FROM {t}" for t, cols in SIMPLE.items() for c, k in cols.items()
    )
    + " UNION ALL SELECT 'orders', 'o_totalprice', 'kpi:revenue', count(o_totalprice) FROM orders UNION ALL SELECT 'events', 'value', 'kpi:revenue', count(value) FROM events"
    + " UNION ALL SELECT 'events', 'user_id', 'kpi:customer_id', count(user_id) FROM events",
)
def semantic_types_simple(spark, sf):
    parts = []
    for name in ("orders", "events"):
        frame = table(spark, sf, name)
        rows = schema_infer.simple_types(frame)
        parts.append(rows.select(F.lit(name).alias("table_name"), "column", "semantic_type", "unique_count"))
        mapped = schema_infer.role_rows(frame, schema_infer.simple_roles(frame))
        parts.append(mapped.select(F.lit(name).alias("table_name"), "column", F.concat(F.lit("kpi:"), "role").alias("semantic_type"), F.col("filled").alias("unique_count")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ROLES = {
    "revenue": "revenue", "profit": "profit", "quantity": "quantity", "date": "order_date", "customer": "customer_id", "product": "product_name",
    "category": "category", "region": "region", "order_id": "order_id", "status": "status",
}


@query("role_mapping", f"WITH {RETAIL} " + " UNION ALL ".join(f"SELECT '{r}' AS role, '{c}' AS \"column\", count({c}) AS filled FROM retail" for r, c in ROLES.items()))
def role_mapping(spark, sf):
    frame = views.retail_frame(spark, sf)
    return schema_infer.role_rows(frame, schema_infer.roles(frame))


DOMAIN = {
    "orders": ("Retail & E-Commerce", 80), "lineitem": ("Retail & E-Commerce", 90), "customer": ("Enterprise Operations / General Tabular", 65),
    "events": ("Enterprise Operations / General Tabular", 65), "part": ("Enterprise Operations / General Tabular", 65),
}


@query("domain_class", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{d}' AS domain, {c} AS confidence, count(*) AS row_count FROM {t}" for t, (d, c) in DOMAIN.items()))
def domain_class(spark, sf):
    out = None
    for name in DOMAIN:
        frame = table(spark, sf, name)
        domain, confidence, _ = schema_infer.classify_domain(frame.columns)
        row = frame.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), F.lit(domain).alias("domain"), F.lit(confidence).alias("confidence"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


MATCHES = [
    ("order_id", "Order-ID", "Normalized Match", 95),
    ("customer_id", "client", "Semantic Synonym", 85),
    ("order_amount", "total_sales", "Semantic Synonym", 85),
    ("order_timestamp", "created_at", "Semantic Synonym", 85),
    ("o_orderpriority", "o_orderpriority", "Exact Name", 100),
]


@query(
    "schema_match",
    """WITH n AS (SELECT count(*) AS n FROM orders), m(col_a, col_b, method, confidence) AS (VALUES """
    + ", ".join(f"('{a}', '{b}', '{m}', {c})" for a, b, m, c in MATCHES)
    + """, ('remark', NULL, 'Only in A', 0), (NULL, 'flag', 'Only in B', 0))
    SELECT col_a, col_b, method, confidence, CASE WHEN col_a IS NOT NULL THEN n END AS filled_a, CASE WHEN col_b IS NOT NULL THEN n END AS filled_b FROM m, n""",
)
def schema_match(spark, sf):
    orders = table(spark, sf, "orders")
    a = orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("order_amount"),
        F.col("o_orderdate").alias("order_timestamp"), "o_orderpriority", F.col("o_orderstatus").alias("remark"),
    )
    b = orders.select(
        F.col("o_orderkey").alias("Order-ID"), F.col("o_custkey").alias("client"), F.col("o_totalprice").alias("total_sales"),
        F.col("o_orderdate").alias("created_at"), "o_orderpriority", F.col("o_orderstatus").alias("flag"),
    )
    return schema_infer.match_rows(a, b)


# --- KPIs ----------------------------------------------------------------------------------------

RETAIL_HALF = f"""{RETAIL}, r AS (SELECT revenue AS v, row_number() OVER (ORDER BY cast(order_date as date), order_id, revenue) AS rn, count(*) OVER () AS n FROM retail),
h AS (SELECT max(n) AS n, sum(CASE WHEN rn <= n // 2 THEN v ELSE 0 END) AS p1, sum(CASE WHEN rn > n // 2 THEN v ELSE 0 END) AS p2 FROM r),
cat AS (SELECT category AS name, sum(revenue) AS v FROM retail GROUP BY 1), reg AS (SELECT region AS name, sum(revenue) AS v FROM retail GROUP BY 1)"""
GROWTH_PCT = f"{dbl('p2 - p1')} * 100.0 / {dbl('p1')}"


def retail(spark, sf):
    """The analyst's table, stored once: KPIs, halves and leaders are separate passes over it."""
    frame = materialize(views.retail_frame(spark, sf), "retail")
    return frame, schema_infer.roles(frame)


KPI_SQL = f"""WITH {RETAIL_HALF} SELECT count(*) AS row_count, {dbl('sum(revenue)')} AS total_revenue, count(DISTINCT order_id) AS total_transactions, sum(quantity) AS total_quantity,
  round(avg(revenue), 4) AS average_revenue, round({dbl('sum(revenue)')} / count(DISTINCT order_id), 4) AS average_transaction_value, {dbl('sum(profit)')} AS total_profit,
  round({dbl('sum(profit)')} / {dbl('sum(revenue)')} * 100.0, 6) AS profit_margin, 0.0::double AS average_cost, count(DISTINCT customer_id) AS unique_customers,
  count(DISTINCT product_name) AS unique_products, count(DISTINCT category) AS unique_categories, count(DISTINCT region) AS unique_regions,
  (SELECT round({GROWTH_PCT}, 6) FROM h) AS growth_pct, (SELECT {dbl('p1')} FROM h) AS prev_period_revenue,
  (SELECT arg_max(name, v) FROM cat) AS top_category_name, (SELECT {dbl('max(v)')} FROM cat) AS top_category_val,
  (SELECT arg_max(name, v) FROM reg) AS top_region_name, (SELECT {dbl('max(v)')} FROM reg) AS top_region_val FROM retail"""


@query("kpi_row", KPI_SQL)
def kpi_row(spark, sf):
    frame, roles = retail(spark, sf)
    out = kpis.kpi_row(frame, roles, "order_id")
    rounded = {"average_revenue": 4, "average_transaction_value": 4, "profit_margin": 6, "growth_pct": 6}
    return out.withColumns({c: F.round(c, d) for c, d in rounded.items()})


@query(
    "kpi_cards",
    f"""WITH {RETAIL} SELECT 'total_value' AS kpi_id, round({dbl('sum(revenue)')}, 4) AS value, 'revenue' AS source_column, 'sum(revenue)' AS formula, 95 AS confidence, count(*) AS rows_included FROM retail
    UNION ALL SELECT 'average_value', round(avg(revenue), 4), 'revenue', 'avg(revenue)', 92, count(*) FROM retail
    UNION ALL SELECT 'profit', round({dbl('sum(profit)')}, 4), 'profit', 'sum(profit)', 94, count(*) FROM retail
    UNION ALL SELECT 'customers', count(DISTINCT customer_id), 'customer_id', 'count(distinct customer_id)', 90, count(*) FROM retail""",
)
def kpi_cards(spark, sf):
    frame, roles = retail(spark, sf)
    domain, _, _ = schema_infer.classify_domain(frame.columns)
    cards = kpis.kpi_cards(kpis.kpi_row(frame, roles, "order_id"), domain, roles)
    return cards.withColumn("value", F.round("value", 4))


@query(
    "driver_decomposition",
    f"""WITH {RETAIL_HALF}, t AS (SELECT sum(revenue) AS t FROM retail)
    SELECT 'period_shift' AS driver, 'revenue' AS subject, {dbl('p2 - p1')} AS value, round({GROWTH_PCT}, 6) AS pct, CASE WHEN p2 >= p1 THEN 'positive' ELSE 'negative' END AS type FROM h
    UNION ALL SELECT 'segment', arg_max(name, v), {dbl('max(v)')}, round({dbl('max(v)')} * 100.0 / {dbl('max(t)')}, 6), 'info' FROM cat, t
    UNION ALL SELECT 'region', arg_max(name, v), {dbl('max(v)')}, round({dbl('max(v)')} * 100.0 / {dbl('max(t)')}, 6), 'info' FROM reg, t""",
)
def driver_decomposition(spark, sf):
    frame, roles = retail(spark, sf)
    out = kpis.driver_decomposition(frame, roles["revenue"], "order_id", roles["date"], roles["category"], roles["region"])
    return out.withColumn("pct", F.round("pct", 6))


@query(
    "target_status",
    f"""WITH {HEADERS}, {CUSTOMERS}, g AS (SELECT state, sum(order_amount) AS actual, count(*) * cast(substr(state, 8) as integer) * 20000 AS target FROM headers JOIN customers USING (customer_id) GROUP BY state),
    d AS (SELECT state, {dbl('actual')} AS a, {dbl('target')} AS t FROM g)
    SELECT state, a AS actual, t AS target, CASE WHEN t > 0 THEN round(a / t * 100, 2) ELSE 0 END AS attainment_pct, CASE WHEN t > 0 THEN round(greatest(0, t - a), 2) END AS remaining,
    CASE WHEN t > 0 THEN round(t - a, 2) END AS gap, CASE WHEN t > 0 THEN round(greatest(0, (t - a) / a * 100), 1) END AS required_growth_pct,
    CASE WHEN t <= 0 THEN 'NO TARGET' WHEN a >= t THEN 'EXCEEDED' WHEN a / t * 100 >= 80 THEN 'ON TRACK' WHEN a / t * 100 >= 50 THEN 'AT RISK' ELSE 'BEHIND' END AS status FROM d""",
)
def target_status(spark, sf):
    per_customer = views.order_headers(spark, sf).groupBy("customer_id").agg(F.sum("order_amount").alias("s"), F.count(F.lit(1)).alias("n"))
    joined = per_customer.join(views.customers(spark, sf), "customer_id").groupBy("state").agg(F.sum("s").cast("double").alias("actual"), F.sum("n").alias("n"))
    target = (F.col("n") * F.substring("state", 8, 9).cast("int") * 20000).cast("double")
    return kpis.target_status(joined.withColumn("target", target).drop("n"), "actual", "target")


@query(
    "insight_facts",
    f"""WITH {RETAIL_HALF}, t AS (SELECT sum(revenue) AS t, sum(profit) AS p, count(*) AS n FROM retail), c AS (SELECT customer_id, sum(revenue) AS v FROM retail GROUP BY 1),
    o AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS rn, greatest(1, cast(floor(count(*) OVER () * 0.2) as bigint)) AS k FROM c),
    d AS (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM retail GROUP BY ALL))
    SELECT 'summary' AS type, 'revenue' AS subject, {dbl('t')} AS value, round({GROWTH_PCT}, 6) AS share_pct FROM t, h
    UNION ALL SELECT 'profitability', 'profit', {dbl('p')}, round({dbl('p')} / {dbl('t')} * 100.0, 6) FROM t
    UNION ALL SELECT 'category', arg_max(name, v), {dbl('max(v)')}, round({dbl('max(v)')} * 100.0 / {dbl('max(t)')}, 6) FROM cat, t
    UNION ALL SELECT 'region', arg_max(name, v), {dbl('max(v)')}, round({dbl('max(v)')} * 100.0 / {dbl('max(t)')}, 6) FROM reg, t
    UNION ALL SELECT 'customer', 'top_20_pct', max(k)::double, round(100.0 * {dbl('sum(CASE WHEN rn <= k THEN v END)')} / {dbl('sum(v)')}, 6) FROM o
    UNION ALL SELECT 'quality', CASE WHEN d = 0 THEN 'clean' ELSE 'attention' END, d::double, NULL FROM (SELECT count(*) - count(DISTINCT retail) AS d FROM retail)""",
)
def insight_facts(spark, sf):
    frame, roles = retail(spark, sf)
    out = kpis.insight_facts(frame, kpis.kpi_row(frame, roles, "order_id"), roles)
    return out.withColumn("share_pct", F.round("share_pct", 6))


@query(
    "top_findings",
    f"""WITH {RETAIL_HALF}, {DIRTY}, {SCORE.replace('p AS (', 'pill AS (').replace('FROM p)', 'FROM pill)')}, t AS (SELECT sum(revenue) AS t FROM retail),
    mon AS (SELECT cast(date_trunc('month', order_date) as date) AS period, sum(revenue)::double AS v FROM retail GROUP BY 1),
    z AS (SELECT *, avg(v) OVER () AS mu, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM mon), a AS (SELECT * FROM z WHERE z > 2.0 OR z < -1.8 ORDER BY period LIMIT 1)
    SELECT 1 AS rank, 'PERFORMANCE' AS badge, 'revenue' AS subject, {dbl('t')} AS value, round({GROWTH_PCT}, 6) AS pct FROM t, h
    UNION ALL SELECT 2, 'LEADER', arg_max(name, v), {dbl('max(v)')}, round({dbl('max(v)')} * 100.0 / {dbl('max(t)')}, 6) FROM cat, t
    UNION ALL SELECT 3, 'ANOMALY', strftime(period, '%Y-%m'), v, round((v - mu) / mu * 100.0, 6) FROM a
    UNION ALL SELECT 4, 'DATA QUALITY', CASE WHEN quality_score >= 95 THEN 'EXCELLENT' WHEN quality_score >= 85 THEN 'GOOD' WHEN quality_score >= 70 THEN 'FAIR' ELSE 'POOR' END, quality_score, NULL FROM scored""",
)
def top_findings(spark, sf):
    frame, roles = retail(spark, sf)
    row = kpis.kpi_row(frame, roles, "order_id")
    anomalies = ts.zscore_anomalies(ts.resample(frame, roles["date"], roles["revenue"], "monthly"))
    score = profile.quality_score(dirty_queries.dirty(spark, sf), dirty_queries.NUMERIC, dirty_queries.DATES)
    return kpis.top_findings(row, anomalies, score).withColumn("pct", F.round("pct", 6))


# --- comparison ------------------------------------------------------------------------------------


def year_of(spark, sf, year):
    return views.order_headers(spark, sf).filter(F.year("purchased_at") == year)


def measures_sql(name: str, year: int) -> str:
    parts = []
    for c in ("order_amount", "customer_id"):
        v = f"{c}::double"
        parts.append(
            f"""SELECT '{c}' AS "column", sum({v}) AS s, avg({v}) AS m, median({v}) AS md, min({v}) AS lo, max({v}) AS hi, stddev_samp({v}) AS sd, count(*) AS n
            FROM headers WHERE year(purchased_at) = {year}"""
        )
    return f"{name} AS ({' UNION ALL '.join(parts)})"


COMPARE = f"{HEADERS}, {measures_sql('a', 1996)}, {measures_sql('b', 1997)}"


@query(
    "dataset_compare",
    f"""WITH {COMPARE} SELECT a."column", a.n AS rows_a, b.n AS rows_b, round({pct_delta('a.n::double', 'b.n::double')}, 6) AS rows_pct, round(a.s, 2) AS sum_a, round(b.s, 2) AS sum_b,
    round(b.s - a.s, 2) AS sum_diff, round({pct_delta('a.s', 'b.s')}, 6) AS sum_pct, round(a.m, 4) AS mean_a, round(b.m, 4) AS mean_b, round({pct_delta('a.m', 'b.m')}, 6) AS mean_pct,
    round(a.md, 4) AS median_a, round(b.md, 4) AS median_b, a.lo AS min_a, b.lo AS min_b, a.hi AS max_a, b.hi AS max_b, round(a.sd, 4) AS std_a, round(b.sd, 4) AS std_b FROM a JOIN b USING ("column")""",
)
def dataset_compare(spark, sf):
    out = compare.dataset_compare(year_of(spark, sf, 1996), year_of(spark, sf, 1997), {"order_amount": "order_amount", "customer_id": "customer_id"})
    digits = {"rows_pct": 6, "sum_pct": 6, "mean_pct": 6, "sum_a": 2, "sum_b": 2, "sum_diff": 2}
    digits |= {f"{m}_{s}": 4 for m in ("mean", "median", "std") for s in "ab"}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "comparison_facts",
    f"""WITH {COMPARE}, {DIRTY}, qa AS (WITH dirty1 AS (SELECT * FROM dirty WHERE record_id % 2 = 0), {SCORE.replace('FROM dirty', 'FROM dirty1')} SELECT * FROM scored),
    qb AS (WITH dirty2 AS (SELECT * FROM dirty WHERE record_id % 2 = 1), {SCORE.replace('FROM dirty', 'FROM dirty2')} SELECT * FROM scored)
    SELECT 'volume' AS type, 'rows' AS subject, (b.n - a.n)::double AS difference, round({pct_delta('a.n::double', 'b.n::double')}, 6) AS change_pct, 'High' AS impact FROM a JOIN b USING ("column") WHERE "column" = 'order_amount' AND a.n <> b.n
    UNION ALL SELECT 'metric', "column", round(b.s - a.s, 2), round({pct_delta('a.s', 'b.s')}, 6), CASE WHEN abs({pct_delta('a.s', 'b.s')}) > 10 THEN 'High' ELSE 'Medium' END FROM a JOIN b USING ("column") WHERE a.s <> b.s
    UNION ALL SELECT 'quality', 'quality_score', round(qb.quality_score - qa.quality_score, 2), round({pct_delta('qa.quality_score', 'qb.quality_score')}, 6), 'Medium' FROM qa, qb WHERE abs(round(qb.quality_score - qa.quality_score, 2)) >= 0.1""",
)
def comparison_facts(spark, sf):
    compared = compare.dataset_compare(year_of(spark, sf, 1996), year_of(spark, sf, 1997), {"order_amount": "order_amount", "customer_id": "customer_id"})
    facts = compare.comparison_facts(compared, quality_sides(spark, sf), ["order_amount", "customer_id"])
    return facts.withColumns({"difference": F.round("difference", 2), "change_pct": F.round("change_pct", 6)})


def quality_sides(spark, sf):
    frame = dirty_queries.dirty(spark, sf)
    even, odd = frame.filter(F.col("record_id") % 2 == 0), frame.filter(F.col("record_id") % 2 == 1)
    return compare.quality_compare(even, odd, dirty_queries.NUMERIC, dirty_queries.DATES)


QUALITY_SQL = {
    "quality_score": "quality_score", "completeness_score": "round(c, 2)", "uniqueness_score": "round(u, 2)", "validity_score": "round(v, 2)", "consistency_score": "round(k, 2)",
    "missing_values": "missing_values", "duplicate_rows": "duplicate_rows", "outlier_count": "outlier_count", "invalid_dates": "invalid_dates", "constant_columns": "constant_columns",
}


def quality_rows(side: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS measure, ({e})::double AS v FROM {side}" for m, e in QUALITY_SQL.items())


@query(
    "quality_compare",
    f"""WITH {DIRTY}, qa AS (WITH dirty1 AS (SELECT * FROM dirty WHERE record_id % 2 = 0), {SCORE.replace('FROM dirty', 'FROM dirty1')} SELECT * FROM scored),
    qb AS (WITH dirty2 AS (SELECT * FROM dirty WHERE record_id % 2 = 1), {SCORE.replace('FROM dirty', 'FROM dirty2')} SELECT * FROM scored), ra AS ({quality_rows('qa')}), rb AS ({quality_rows('qb')})
    SELECT measure, ra.v AS value_a, rb.v AS value_b, round(rb.v - ra.v, 2) AS delta FROM ra JOIN rb USING (measure)""",
)
def quality_compare(spark, sf):
    return quality_sides(spark, sf)


DIFF = """a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0),
d AS (SELECT coalesce(a.k, b.k)::varchar AS key, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'new' WHEN a.s <> b.s THEN 'changed' ELSE 'common' END AS state FROM a FULL JOIN b ON a.k = b.k)"""


@query("record_diff", f"WITH {DIFF} SELECT key, state FROM d")
def record_diff(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    a = orders.filter(F.col("o_orderkey") % 10 != 0)
    b = orders.filter(F.col("o_orderkey") % 7 != 0)
    b = b.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return compare.record_diff(a, b, "o_orderkey", "o_orderkey", [("o_orderstatus", "o_orderstatus")], ["o_orderstatus"], ["o_orderstatus"])


SHIFT = f"""WITH {ITEMS}, {PRODUCTS}, t AS (SELECT category, item_price, year(delivered_at) AS y FROM items JOIN products USING (product_id)),
    a AS (SELECT category, {dbl('sum(item_price)')} AS v FROM t WHERE y = 1996 AND category <> 'PROMO' GROUP BY 1), b AS (SELECT category, {dbl('sum(item_price)')} AS v FROM t WHERE y = 1997 AND category <> 'SMALL' GROUP BY 1),
    j AS (SELECT coalesce(a.category, b.category) AS category, coalesce(a.v, 0) AS x, coalesce(b.v, 0) AS y, CASE WHEN a.v IS NULL THEN 'New in B' WHEN b.v IS NULL THEN 'Only in A' ELSE 'Common' END AS status
      FROM a FULL JOIN b ON a.category = b.category),
    s AS (SELECT category, x AS value_a, y AS value_b, round(y - x, 2) AS shift, round({pct_delta('x', 'y')}, 6) AS growth_pct, status FROM j)"""


@query("category_shift", f"{SHIFT} SELECT * FROM s")
def category_shift(spark, sf):
    joined = views.order_items(spark, sf).join(views.products(spark, sf), "product_id")
    a = joined.filter((F.year("delivered_at") == 1996) & (F.col("category") != "PROMO"))
    b = joined.filter((F.year("delivered_at") == 1997) & (F.col("category") != "SMALL"))
    out = compare.category_shift(a, b, "category", "category", F.col("item_price"), F.col("item_price"))
    return out.withColumns({"shift": F.round("shift", 2), "growth_pct": F.round("growth_pct", 6)})


@query("category_growth_top", f"{SHIFT} SELECT * FROM s ORDER BY growth_pct DESC, category LIMIT 3")
def category_growth_top(spark, sf):
    return compare.top_growing(category_shift(spark, sf))


@query(
    "dimension_compare",
    f"""WITH {ITEMS}, {PRODUCTS}, t AS (SELECT category, item_price FROM items JOIN products USING (product_id)),
    g AS (SELECT {dbl("sum(CASE WHEN category = 'LARGE' THEN item_price END)")} AS va, {dbl("sum(CASE WHEN category = 'MEDIUM' THEN item_price END)")} AS vb,
      count(CASE WHEN category = 'LARGE' THEN 1 END) AS na, count(CASE WHEN category = 'MEDIUM' THEN 1 END) AS nb FROM t)
    SELECT 'LARGE' AS item_a, 'MEDIUM' AS item_b, va AS value_a, vb AS value_b, na AS count_a, nb AS count_b, round(va / na, 4) AS average_a, round(vb / nb, 4) AS average_b,
    round(va - vb, 2) AS difference, round({pct_delta('vb', 'va')}, 6) AS difference_pct, CASE WHEN va >= vb THEN 'LARGE' ELSE 'MEDIUM' END AS leader FROM g""",
)
def dimension_compare(spark, sf):
    joined = views.order_items(spark, sf).join(views.products(spark, sf), "product_id")
    out = compare.dimension_compare(joined, "category", "LARGE", "MEDIUM", "item_price")
    digits = {"average_a": 4, "average_b": 4, "difference": 2, "difference_pct": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "trend_overlay",
    f"""WITH {HEADERS}, a AS (SELECT order_year_month AS period, {dbl('sum(order_amount)')} AS v FROM headers WHERE order_status = 'F' AND month(purchased_at) <> 6 GROUP BY 1),
    b AS (SELECT order_year_month AS period, {dbl('sum(order_amount)')} AS v FROM headers WHERE order_status = 'O' AND month(purchased_at) <> 2 GROUP BY 1)
    SELECT period, a.v AS value_a, b.v AS value_b FROM a FULL JOIN b USING (period)""",
)
def trend_overlay(spark, sf):
    headers = views.order_headers(spark, sf)
    a = headers.filter((F.col("order_status") == "F") & (F.month("purchased_at") != 6))
    b = headers.filter((F.col("order_status") == "O") & (F.month("purchased_at") != 2))
    return compare.trend_overlay(a, b, "purchased_at", "purchased_at", "order_amount", "order_amount", lambda c: F.date_format(c, "yyyy-MM"))


# --- drill-down --------------------------------------------------------------------------------------


@query(
    "hierarchies",
    f"""WITH {RETAIL} SELECT 'Time Hierarchy' AS hierarchy, 1 AS level, 'Year' AS level_name, count(DISTINCT year(order_date)) AS members FROM retail
    UNION ALL SELECT 'Time Hierarchy', 2, 'Quarter', count(DISTINCT (year(order_date), quarter(order_date))) FROM retail UNION ALL SELECT 'Time Hierarchy', 3, 'Month', count(DISTINCT date_trunc('month', order_date)) FROM retail
    UNION ALL SELECT 'Time Hierarchy', 4, 'Day', count(DISTINCT cast(order_date as date)) FROM retail
    UNION ALL SELECT 'Product Hierarchy', 1, 'category', count(DISTINCT category) FROM retail UNION ALL SELECT 'Product Hierarchy', 2, 'product_name', count(DISTINCT product_name) FROM retail""",
)
def hierarchies(spark, sf):
    """Supported hierarchies with the number of members per level."""
    frame, roles = retail(spark, sf)
    found = drill.hierarchies(frame.columns, roles["date"])
    entries, labels = [], []
    for title, levels in found.items():
        for number, level in enumerate(levels, start=1):
            name = f"_l{len(labels)}"
            source = drill.level_label(roles["date"], level) if title.startswith("Time") else F.col(level)
            labels.append(source.alias(name))
            entries.append((name, F.struct(F.lit(title).alias("hierarchy"), F.lit(number).alias("level"), F.lit(level).alias("level_name"))))
    counts = profile.column_counts(frame.select(*labels))
    names = F.create_map(*[x for name, info in entries for x in (F.lit(name), info)])
    return counts.withColumn("i", names[F.col("column")]).select("i.*", F.col("unique_count").alias("members"))


@query(
    "drill_time",
    f"""WITH {HEADERS} SELECT 'Year' AS level, strftime(purchased_at, '%Y') AS period, {dbl('sum(order_amount)')} AS total, count(*) AS transactions, round(avg(order_amount), 4) AS average FROM headers GROUP BY 2
    UNION ALL SELECT 'Quarter', year(purchased_at) || 'Q' || quarter(purchased_at), {dbl('sum(order_amount)')}, count(*), round(avg(order_amount), 4) FROM headers WHERE year(purchased_at) = 1996 GROUP BY 2
    UNION ALL SELECT 'Month', strftime(purchased_at, '%Y-%m'), {dbl('sum(order_amount)')}, count(*), round(avg(order_amount), 4) FROM headers WHERE year(purchased_at) = 1996 AND quarter(purchased_at) = 2 GROUP BY 2
    UNION ALL SELECT 'Day', strftime(purchased_at, '%Y-%m-%d'), {dbl('sum(order_amount)')}, count(*), round(avg(order_amount), 4) FROM headers WHERE strftime(purchased_at, '%Y-%m') = '1996-05' GROUP BY 2""",
)
def drill_time(spark, sf):
    headers = views.order_headers(spark, sf)
    out = None
    for level, parent in [("Year", None), ("Quarter", "1996"), ("Month", "1996Q2"), ("Day", "1996-05")]:
        rows = drill.drill_time(headers, "purchased_at", "order_amount", level, parent)
        rows = rows.select(F.lit(level).alias("level"), "period", "total", "transactions", F.round("average", 4).alias("average"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "rollup_time",
    f"""WITH {HEADERS}, d AS (SELECT strftime(purchased_at, '%Y') AS year, year(purchased_at) || 'Q' || quarter(purchased_at) AS quarter, strftime(purchased_at, '%Y-%m') AS month,
      strftime(purchased_at, '%Y-%m-%d') AS day, order_amount FROM headers)
    SELECT year, quarter, month, day, CASE grouping_id(year, quarter, month, day) WHEN 0 THEN 'Day' WHEN 1 THEN 'Month' WHEN 3 THEN 'Quarter' WHEN 7 THEN 'Year' ELSE 'Total' END AS level,
    {dbl('sum(order_amount)')} AS total, count(*) AS transactions FROM d GROUP BY ROLLUP (year, quarter, month, day)""",
)
def rollup_time(spark, sf):
    return drill.rollup_time(views.order_headers(spark, sf), "purchased_at", "order_amount")


@query(
    "drill_dimension",
    f"""WITH {HEADERS}, {CUSTOMERS}, t AS (SELECT state, order_amount FROM headers JOIN customers USING (customer_id) WHERE region = 'ASIA'), g AS (SELECT state, sum(order_amount) AS s, count(*) AS n FROM t GROUP BY 1)
    SELECT state, {dbl('s')} AS total, n AS rows, round({dbl('s')} * 100.0 / {dbl('sum(s) OVER ()')}, 2) AS share_pct FROM g""",
)
def drill_dimension(spark, sf):
    joined = views.order_headers(spark, sf).join(views.customers(spark, sf), "customer_id")
    return drill.drill_dimension(joined, "region", "state", "ASIA", "order_amount")


@query(
    "rollup_dimension",
    f"""WITH {HEADERS}, {CUSTOMERS}, t AS (SELECT region, state, order_amount FROM headers JOIN customers USING (customer_id)),
    r AS (SELECT region, sum(order_amount) AS s FROM t GROUP BY 1)
    SELECT t.region, state, 'child' AS level, {dbl('sum(order_amount)')} AS total, count(*) AS rows, round({dbl('sum(order_amount)')} * 100.0 / {dbl('max(s)')}, 6) AS share_pct FROM t JOIN r ON t.region = r.region GROUP BY 1, 2
    UNION ALL SELECT region, NULL, 'parent', {dbl('sum(order_amount)')}, count(*), 100.0 FROM t GROUP BY 1 UNION ALL SELECT NULL, NULL, 'total', {dbl('sum(order_amount)')}, count(*), NULL FROM t""",
)
def rollup_dimension(spark, sf):
    joined = views.order_headers(spark, sf).join(views.customers(spark, sf), "customer_id")
    return drill.rollup_dimension(joined, "region", "state", "order_amount")
