"""Shared pieces of oracle SQL."""

from __future__ import annotations

FREIGHT = "cast(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)) as decimal(12,2))"

ITEMS = f"""items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, 1 AS order_item_quantity, l_quantity AS quantity,
         cast(l_extendedprice as decimal(12,2)) AS item_price,
         {FREIGHT} AS freight_value,
         cast(cast(l_extendedprice as decimal(12,2)) + {FREIGHT} as decimal(12,2)) AS total_item_value,
         l_discount AS discount, l_shipdate AS delivered_at
  FROM lineitem)"""

HEADERS = """headers AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderpriority AS order_priority, cast(o_totalprice as decimal(12,2)) AS order_amount,
         o_orderdate AS purchased_at, o_orderdate + INTERVAL 30 DAY AS estimated_at,
         strftime(o_orderdate, '%Y-%m') AS order_year_month,
         cast(strftime(o_orderdate, '%Y%m%d') as integer) AS order_date_key
  FROM orders)"""

CUSTOMERS = """customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id, c_mktsegment AS segment,
         n_name AS state, r_name AS region, cast(c_acctbal as decimal(12,2)) AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS sub_category,
         p_size AS size, cast(p_retailprice as decimal(12,2)) AS list_price FROM part)"""

SELLERS = """sellers AS (
  SELECT s_suppkey AS seller_id, s_name AS seller_name, n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

LINES = f"""{ITEMS}, {HEADERS}, lines AS (SELECT * FROM items JOIN headers USING (order_id))"""


def dbl(expr: str) -> str:
    return f"cast({expr} as double)"


def big(expr: str) -> str:
    return f"cast({expr} as bigint)"


def mean_money(total: str, count: str) -> str:
    """total / count rounded half up to cents with integer arithmetic (non-negative totals)."""
    cents = f"cast(({total}) * 100 as hugeint)"
    n = f"cast({count} as hugeint)"
    return f"CASE WHEN {count} = 0 THEN NULL ELSE cast((2 * {cents} + {n}) // (2 * {n}) as double) / 100 END"


def pct_delta(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0.0 WHEN {a} = 0 AND {b} > 0 THEN 100.0 "
        f"WHEN {a} = 0 THEN -100.0 ELSE ({b} - {a}) / abs({a}) * 100.0 END"
    )


def leaf_sql(fields: list[str]) -> str:
    """Digest of a hash tree's leaf over text fields."""
    return "sha256('leaf:' || " + " || ".join(f"coalesce(length({f})::varchar || ':' || {f}, '-')" for f in fields) + ")"


def tree_sql(leaves: str, keys: str, fanout: int, height: int = 8) -> str:
    """CTEs t0 to t{height} of a hash tree over ``leaves`` (keys, node, digest); lone nodes go up unchanged."""
    out = [f"t0 AS ({leaves})"]
    for level in range(height):
        out.append(
            f"t{level + 1} AS (SELECT {keys}, parent AS node, CASE WHEN count(*) = 1 THEN max(digest) ELSE sha256('node:' || string_agg(digest, '' ORDER BY node)) END AS digest "
            f"FROM (SELECT *, node // {fanout} AS parent FROM t{level}) GROUP BY {keys}, parent)"
        )
    return ", ".join(out)
