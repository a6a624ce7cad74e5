"""Sources, sinks, ingestion, versions and contracts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import raw, views
from ..functions.keys import surrogate_key
from ..functions.text import spreadsheet_safe
from ..operators import rules
from ..operators.select import text_columns
from ..plans import gold, silver
from ..session import shared_dir
from ..sources import bronze, contract, files, splits, versions, warehouse
from .registry import query, table
from .silver import CUST, GEO, lake_of
from .sqlbits import ITEMS, big, dbl, leaf_sql, tree_sql

ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("csv_scan_roundtrip", "SELECT cast(doc_id as varchar) AS doc_id, '\"' || source || '\",;' || chr(10) || lang AS note, length(text) AS text_length FROM documents")
def csv_scan_roundtrip(spark, sf):
    """Whole texts with quotes and line breaks written as CSV and scanned back as text columns."""
    path = shared_dir(spark, "csv")
    note = F.concat(F.lit('"'), "source", F.lit('",;\n'), "lang")
    docs = table(spark, sf, "documents").select("doc_id", note.alias("note"), "text")
    docs.write.options(header="true", quote='"', escape='"', quoteAll="true").csv(path)
    back = files.read_csv(spark, path)
    return back.select("doc_id", "note", F.length("text").cast("bigint").alias("text_length"))


@query("header_normalize", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def header_normalize(spark, sf):
    messy = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("\ufeffc_custkey"), F.col("c_name").alias("  c_name "), F.col("c_nationkey").alias("c_nationkey\t")
    )
    return files.normalize_header(messy)


REQUIRED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_approved_at"],
    "customer": ["c_custkey", "c_name"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_freight"],
    "events": ["event_id", "ts"],
}
ABSENT = {"o_approved_at", "l_freight"}


@query(
    "schema_contract",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", {str(c not in ABSENT).lower()} AS present, {'count(*) * 0' if c in ABSENT else f'count({c})'} AS filled FROM {t}"
        for t, cols in REQUIRED.items()
        for c in cols
    ),
)
def schema_contract(spark, sf):
    out = None
    for name, required in REQUIRED.items():
        rows = files.contract_rows(table(spark, sf, name), name, required)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("input_guards", "SELECT 'present' AS source, 'OK' AS status, count(*) AS row_count FROM customer UNION ALL SELECT 'absent', 'MISSING', 0 UNION ALL SELECT 'header_only', 'NO_ROWS', 0")
def input_guards(spark, sf):
    root = shared_dir(spark, "guards")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    customers.write.option("header", "true").csv(f"{root}/present")
    customers.filter(F.col("c_custkey") < 0).coalesce(1).write.option("header", "true").csv(f"{root}/header_only")
    out = None
    for name in ("present", "absent", "header_only"):
        status = files.input_status(spark, f"{root}/{name}")
        if status == "OK":
            rows = files.read_csv(spark, f"{root}/{name}").agg(F.count(F.lit(1)).alias("row_count"))
        else:
            rows = spark.range(1).select(F.lit(0).cast("bigint").alias("row_count"))
        row = rows.select(F.lit(name).alias("source"), F.lit(status).alias("status"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "audit_columns",
    """SELECT o_orderkey, strftime(timestamp '2024-02-01', '%Y-%m-%d %H:%M:%S') AS _ingested_at, 'orders.parquet' AS _source_file, 'shop' AS _source_system, '1.0' AS _schema_version,
    '2024-02' AS ingestion_year_month FROM orders""",
)
def audit_columns(spark, sf):
    out = bronze.audit_columns(table(spark, sf, "orders"), "shop", "1.0", "2024-02-01 00:00:00")
    return out.select(
        "o_orderkey", F.date_format("_ingested_at", "yyyy-MM-dd HH:mm:ss").alias("_ingested_at"), "_source_file", "_source_system", "_schema_version", "ingestion_year_month"
    )


@query("partitioned_write", "SELECT strftime(l_shipdate, '%Y') AS ship_year, count(*) AS rows, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def partitioned_write(spark, sf):
    """Written twice: the second run replaces the partitions instead of adding to them."""
    path = shared_dir(spark, "partitioned") + "/lineitem"
    items = table(spark, sf, "lineitem").withColumn("ship_year", F.date_format("l_shipdate", "yyyy"))
    for _ in range(2):
        bronze.write_table(items, path, ["ship_year"])
    back = spark.read.parquet(path)
    per_order = back.groupBy(F.col("ship_year").cast("string").alias("ship_year"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_order.groupBy("ship_year").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("orders"))


@query("write_variance", "SELECT 'orders' AS entity, count(*) AS source_rows, count(*) AS written_rows, 0::bigint AS variance FROM orders UNION ALL SELECT 'lineitem', count(*), count(*), 0 FROM lineitem")
def write_variance(spark, sf):
    root = shared_dir(spark, "variance")
    a = bronze.write_with_variance(table(spark, sf, "orders"), f"{root}/orders", "orders")
    b = bronze.write_with_variance(table(spark, sf, "lineitem"), f"{root}/lineitem", "lineitem")
    return a.unionByName(b)


WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6}
PARTITIONED = {"orders": "ingestion_year_month", "lineitem": "ingestion_year_month"}


@query(
    "ingest_manifest",
    "WITH m AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS entity, count(*) AS row_count, {WIDTHS[t]}::bigint AS columns, {repr(PARTITIONED[t]) if t in PARTITIONED else 'NULL'} AS partitioned_by FROM {t}" for t in ALL
    )
    + f") SELECT * FROM m UNION ALL SELECT 'TOTAL', {big('sum(row_count)')}, {big('sum(columns)')}, NULL FROM m",
)
def ingest_manifest(spark, sf):
    return bronze.manifest({t: table(spark, sf, t) for t in ALL}, PARTITIONED)


@query("parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def parquet_scan(spark, sf):
    return bronze.read_table(spark, sf, "orders.parquet").select("o_orderkey", "o_totalprice")


@query(
    "multi_format_read",
    """SELECT f AS format, count(*) AS row_count, cast(sum(c_nationkey) as bigint) AS nation_sum FROM customer, (SELECT unnest(['parquet', 'csv', 'jsonl', 'json']) AS f) GROUP BY 1""",
)
def multi_format_read(spark, sf):
    root = shared_dir(spark, "formats")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    customers.write.parquet(f"{root}/c.parquet")
    customers.write.option("header", "true").option("sep", ";").csv(f"{root}/c.csv")
    customers.write.json(f"{root}/c.jsonl")
    customers.write.json(f"{root}/c.json")
    out = None
    for suffix in ("parquet", "csv", "jsonl", "json"):
        frame = files.read_any(spark, f"{root}/c.{suffix}")
        row = frame.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("c_nationkey").cast("bigint")).alias("nation_sum"))
        row = row.select(F.lit(suffix).alias("format"), "row_count", "nation_sum")
        out = row if out is None else out.unionByName(row)
    return out


@query("delimiter_sniff", "SELECT name AS file, delimiter, count(*) AS row_count FROM customer, (SELECT unnest(['comma', 'semicolon', 'tab', 'pipe']) AS name, unnest([',', ';', chr(9), '|']) AS delimiter) GROUP BY 1, 2")
def delimiter_sniff(spark, sf):
    """Files whose texts contain commas as well; the vote still finds the real delimiter."""
    root = shared_dir(spark, "delimiters")
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("; x, y"))).otherwise(F.col("c_name")).alias("c_name"), "c_mktsegment"
    )
    out = None
    for name, sep in [("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")]:
        customers.write.option("header", "true").option("sep", sep).csv(f"{root}/{name}")
        found = files.sniff_delimiter(spark, f"{root}/{name}")
        rows = files.read_csv(spark, f"{root}/{name}", found).agg(F.count(F.lit(1)).alias("row_count"))
        row = rows.select(F.lit(name).alias("file"), F.lit(found).alias("delimiter"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


@query("csv_range_scan", "SELECT cast(doc_id as varchar) AS doc_id, '\"' || source || '\",;' || chr(10) || lang AS note, length(text) AS text_length FROM documents")
def csv_range_scan(spark, sf):
    """The same files as ``csv_scan_roundtrip``, read in byte ranges whatever their size."""
    path = shared_dir(spark, "csv")
    note = F.concat(F.lit('"'), "source", F.lit('",;\n'), "lang")
    docs = table(spark, sf, "documents").select("doc_id", note.alias("note"), "text")
    docs.write.options(header="true", quote='"', escape='"', quoteAll="true").csv(path)
    return splits.read_csv_ranges(spark, path).select("doc_id", "note", F.length("text").cast("bigint").alias("text_length"))


@query("json_array_range_scan", "SELECT doc_id, source, lang, length(text) AS text_length, sha256(text) AS text_sha256 FROM documents")
def json_array_range_scan(spark, sf):
    """Whole documents written as JSON arrays on one line each, sixteen files, and read back in byte ranges."""
    path = shared_dir(spark, "json-array")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    ordered = W.partitionBy("part").orderBy("doc_id")
    rows = docs.select(F.pmod("doc_id", F.lit(16)).alias("part"), "doc_id", F.to_json(F.struct(*docs.columns)).alias("body"))
    opening = F.when(F.row_number().over(ordered) == 1, "[").otherwise(",")
    closing = F.when(F.lead("doc_id").over(ordered).isNull(), "]").otherwise("")
    lines = rows.select("part", "doc_id", F.concat(opening, "body", closing).alias("value")).sortWithinPartitions("part", "doc_id")
    lines.select("part", "value").write.option("lineSep", " ").partitionBy("part").text(path)
    back = splits.read_json_ranges(spark, path)
    return back.select("doc_id", "source", "lang", F.length("text").cast("bigint").alias("text_length"), F.sha2("text", 256).alias("text_sha256"))


LINE_SQL = "cast(doc_id as varchar) || ' ' || replace(coalesce(text, ''), chr(10), ' ')"


@query(
    "file_tree_fingerprint",
    f"""WITH rows_of AS (SELECT cast(doc_id % 4 as bigint) AS part, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS node, {LINE_SQL} AS line FROM documents),
    {tree_sql(f"SELECT part, node, {leaf_sql(['line'])} AS digest FROM rows_of", "part", 16)}
    SELECT part, (SELECT count(*) FROM t0 WHERE t0.part = t8.part) AS lines, digest AS fingerprint FROM t8""",
)
def file_tree_fingerprint(spark, sf):
    """Fingerprints of four texts that hold all documents, one per line in order of their ids, each in files by range of ids."""
    path = shared_dir(spark, "lines")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    rows = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(4)).alias("part"), "doc_id", "text")
    rows = rows.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    rows.select("part", line.alias("value")).write.partitionBy("part").text(path)
    found = splits.file_fingerprints(spark, path, 16, folders=True)
    return found.select(F.regexp_extract("path", r"part=(\d+)$", 1).cast("bigint").alias("part"), "lines", "fingerprint")


@query("sanitize_columns", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS name_1, c_nationkey AS unnamed_column_4 FROM customer")
def sanitize_columns(spark, sf):
    messy = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").toDF(" id\x07", "name", "name ", " ")
    return files.sanitize_columns(messy)


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf):
    out = None
    for name in ("nation", "orders", "documents"):
        row = files.fingerprint(table(spark, sf, name)).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "warehouse_row_counts",
    f"WITH {GEO} SELECT 'dim_customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'dim_product', count(*) FROM part UNION ALL SELECT 'dim_seller', count(*) FROM supplier UNION ALL SELECT 'fact_sales', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "UNION ALL SELECT 'dim_date', cast(make_date(year(max(o_orderdate)), 12, 31) - make_date(year(min(o_orderdate)), 1, 1) as bigint) + 1 FROM orders UNION ALL SELECT 'dim_location', count(*) FROM centroid",
)
def warehouse_row_counts(spark, sf):
    root = shared_dir(spark, "warehouse")
    tables = {**star(spark, sf), "dim_location": gold.dim_location(silver.centroids(lake_of(spark, sf).valid("geolocation")))}
    warehouse.load_warehouse(tables, warehouse.parquet_writer(root))
    return warehouse.row_counts(spark, root, list(tables))


@query(
    "run_history",
    """SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type AS pipeline, count(*) AS row_count, round(sum(value), 2) AS duration_seconds FROM events GROUP BY 1, 2""",
)
def run_history(spark, sf):
    """One record per day and pipeline, appended in two goes and read back with a fixed schema."""
    path = shared_dir(spark, "history")
    daily = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_type").alias("pipeline")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("duration_seconds")
    )
    records = daily.withColumns({"status": F.lit("SUCCESS"), "metadata": F.create_map(F.lit("source"), F.col("pipeline"))})
    bronze.append_history(records.filter(F.col("run_id") < "2024-01-15"), path)
    bronze.append_history(records.filter(F.col("run_id") >= "2024-01-15"), path)
    back = bronze.read_history(spark, path)
    return back.select("run_id", "pipeline", "row_count", F.round("duration_seconds", 2).alias("duration_seconds"))


@query("quarantine_write", f"WITH {CUST} SELECT array_to_string(ids, '; ') AS rule_ids, count(*) AS rows FROM cust_flagged WHERE len(ids) > 0 GROUP BY 1")
def quarantine_write(spark, sf):
    """The same batch is written twice; its partition is replaced, not doubled."""
    path = shared_dir(spark, "quarantine")
    rejected = rules.quarantine(lake_of(spark, sf).flagged("customers"), "silver_customers", "batch_1", "2024-01-31T00:00:00Z")
    for _ in range(2):
        bronze.write_quarantine(rejected, path, "batch_1", "2024-01-31T00:00:00Z")
    return spark.read.parquet(path).groupBy(F.col("_dq_rule_id").alias("rule_ids")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "csv_injection_guard",
    r"""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '=' || source WHEN 1 THEN ' @' || source WHEN 2 THEN '-' || cast(doc_id as varchar) || '.5' WHEN 3 THEN '+' || source WHEN 4 THEN '-' ELSE text END AS v FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(ltrim(v, chr(9) || chr(10) || chr(13) || ' '), '^[=@]') OR (regexp_matches(ltrim(v, chr(9) || chr(10) || chr(13) || ' '), '^[+\-]')
      AND NOT regexp_full_match(ltrim(v, chr(9) || chr(10) || chr(13) || ' '), '[+\-](\d+\.?\d*|\.\d+)')) THEN '''' || v ELSE v END AS cell FROM t""",
)
def csv_injection_guard(spark, sf):
    key = F.col("doc_id")
    cell = (
        F.when(key % 6 == 0, F.concat(F.lit("="), "source"))
        .when(key % 6 == 1, F.concat(F.lit(" @"), "source"))
        .when(key % 6 == 2, F.concat(F.lit("-"), key.cast("string"), F.lit(".5")))
        .when(key % 6 == 3, F.concat(F.lit("+"), "source"))
        .when(key % 6 == 4, F.lit("-"))
        .otherwise(F.col("text"))
    )
    docs = table(spark, sf, "documents").select("doc_id", cell.alias("cell"))
    return docs.withColumns({c: spreadsheet_safe(c) for c in text_columns(docs)})


@query(
    "snapshot_versions",
    """SELECT 0 AS version, 0 AS steps, count(*) AS rows FROM orders UNION ALL SELECT 1, 1, count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 2, 2, count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000""",
)
def snapshot_versions(spark, sf):
    root = shared_dir(spark, "snapshots")
    original = table(spark, sf, "orders")
    cleaned = original.filter(F.col("o_orderstatus") != "P")
    steps = [{"action": "filter", "params": {"status": "not P"}}, {"action": "filter", "params": {"price": "over 100000"}}]
    versions.save_version(original, root, "orders", 0, [])
    versions.save_version(cleaned, root, "orders", 1, steps[:1])
    versions.save_version(cleaned.filter(F.col("o_totalprice") > 100000), root, "orders", 2, steps)
    counts = spark.read.parquet(f"{root}/orders/data").groupBy("version").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(versions.load_recipes(spark, root, "orders"), "version").select("version", "steps", "rows")


# --- star views and their contract -----------------------------------------------------------------


def star(spark, sf):
    """Small star schema straight from the views; every third seller is missing on purpose."""
    people = views.customers(spark, sf)
    headers = views.order_headers(spark, sf)
    lines = views.order_items(spark, sf).join(headers, "order_id")
    return {
        "dim_customer": people.withColumn("customer_key", surrogate_key(F.col("customer_id"), F.lit("v1"))),
        "dim_product": views.products(spark, sf).withColumn("product_key", surrogate_key("product_id")),
        "dim_seller": views.sellers(spark, sf).withColumn("seller_key", surrogate_key("seller_id")),
        "dim_date": gold.calendar(gold.whole_years(table(spark, sf, "orders"), "o_orderdate")),
        "fact_sales": lines.select(
            surrogate_key("order_id", "order_item_id").alias("sales_fact_key"),
            "order_id",
            "order_item_id",
            "customer_id",
            "product_id",
            "seller_id",
            "order_date_key",
            "item_price",
            "freight_value",
            "total_item_value",
        ),
    }


CONTRACT = {
    "fact_sales": {
        "required": ["sales_fact_key", "order_id", "order_item_id", "order_date_key", "item_price", "freight_value", "total_item_value"],
        "key": ["order_id", "order_item_id"],
        "references": {
            "customer_id": ("dim_customer", "customer_id"),
            "product_id": ("dim_product", "product_id"),
            "seller_id": ("dim_seller", "seller_id"),
            "order_date_key": ("dim_date", "date_key"),
        },
    },
    "dim_customer": {"required": ["customer_key", "customer_id", "customer_unique_id", "state"], "key": ["customer_id"]},
    "dim_product": {"required": ["product_key", "product_id", "product_volume_cm3"], "key": ["product_id"]},
    "dim_seller": {"required": ["seller_key", "seller_id", "seller_state"], "key": ["seller_id"]},
    "dim_date": {"required": ["date_key", "full_date", "is_weekend"], "key": ["date_key"]},
    "dim_location": {"required": ["location_key"], "key": ["location_key"]},
}


def _keys_sql(table: str, key: str, columns: str, source: str) -> str:
    return f"""SELECT '{table}' AS table_name, 'unique:{key}' AS "check", CASE WHEN v = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, v AS violations
    FROM (SELECT cast(coalesce(sum(n - 1), 0) as bigint) AS v FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns}))"""


def _parent_sql(key: str, child: str, parent: str) -> str:
    return f"""SELECT 'fact_sales', 'reference:{key}', CASE WHEN v = 0 THEN 'PASSED' ELSE 'FAILED' END, v FROM (SELECT count(*) AS v FROM f ANTI JOIN (SELECT DISTINCT {parent}) p ON p.k = f.{child})"""


def _schema_sql(table: str, source: str) -> str:
    return f"""SELECT '{table}', 'schema', CASE WHEN count(*) = 0 THEN 'EMPTY' ELSE 'COMPATIBLE' END, 0::bigint FROM {source}"""


FINDINGS_SQL = f"""WITH f AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), people AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sellers AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 31 <> 0),
days AS (SELECT unnest(generate_series(date_trunc('year', min(o_orderdate)), date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM orders),
findings AS ({_keys_sql("fact_sales", "order_id,order_item_id", "l_orderkey, l_linenumber", "f")}
  UNION ALL {_schema_sql("fact_sales", "f")} UNION ALL {_schema_sql("dim_customer", "people")} UNION ALL {_schema_sql("dim_seller", "sellers")} UNION ALL {_schema_sql("dim_date", "days")}
  UNION ALL {_keys_sql("dim_customer", "customer_id", "c_custkey", "people")} UNION ALL {_keys_sql("dim_product", "product_id", "p_partkey", "part")}
  UNION ALL {_keys_sql("dim_seller", "seller_id", "s_suppkey", "sellers")} UNION ALL {_keys_sql("dim_date", "date_key", "d", "days")}
  UNION ALL {_parent_sql("customer_id", "o_custkey", "c_custkey AS k FROM people")} UNION ALL {_parent_sql("product_id", "l_partkey", "p_partkey AS k FROM part")}
  UNION ALL {_parent_sql("seller_id", "l_suppkey", "s_suppkey AS k FROM sellers")} UNION ALL {_parent_sql("order_date_key", "o_orderdate::date", "d::date AS k FROM days")}
  UNION ALL SELECT 'dim_product', 'schema', 'SCHEMA_MISMATCH', 1 UNION ALL SELECT 'dim_location', 'schema', 'MISSING', 1)"""


def exported(spark, sf):
    """The star with a column, a dimension and every 31st seller missing."""
    tables = star(spark, sf)
    tables["dim_seller"] = tables["dim_seller"].filter(F.col("seller_id") % 31 != 0)
    return tables


@query("contract_validate", f"{FINDINGS_SQL} SELECT * FROM findings")
def contract_validate(spark, sf):
    return contract.validate(exported(spark, sf), CONTRACT)


@query(
    "export_manifest",
    f"""{FINDINGS_SQL}, {ITEMS}, held AS (SELECT i.* FROM items i JOIN orders ON i.order_id = o_orderkey)
    SELECT 'retail_lake' AS target, '2024-02-01 00:00:00' AS generated_at, table_name, count(*) AS checks, count(CASE WHEN status NOT IN ('COMPATIBLE', 'PASSED') THEN 1 END) AS broken, cast(sum(violations) as bigint) AS violations,
    (SELECT bool_and(status IN ('COMPATIBLE', 'PASSED')) FROM findings) AS exportable, (SELECT {dbl("sum(total_item_value)")} FROM held) AS total_gross_revenue, (SELECT {dbl("sum(freight_value)")} FROM held) AS total_freight_revenue,
    (SELECT count(*) FROM held) AS total_fact_rows, (SELECT count(DISTINCT order_id) FROM held) AS total_distinct_orders FROM findings GROUP BY table_name""",
)
def export_manifest(spark, sf):
    """The manifest of the same star, written, read back and counted per table."""
    made = contract.export_manifest(exported(spark, sf), CONTRACT, "fact_sales", "retail_lake", "2024-02-01 00:00:00")
    back = contract.write_manifest(made, shared_dir(spark, "manifest"))
    rows = back.select("target", "generated_at", "exportable", "reconciled_metrics", F.explode("compatibility").alias("c"))
    broken = F.count_if(~F.col("c.status").isin("COMPATIBLE", "PASSED"))
    per_table = rows.groupBy("target", "generated_at", F.col("c.table_name").alias("table_name"), "exportable", "reconciled_metrics")
    counted = per_table.agg(F.count(F.lit(1)).alias("checks"), broken.alias("broken"), F.sum("c.violations").alias("violations"))
    metrics = ("total_gross_revenue", "total_freight_revenue", "total_fact_rows", "total_distinct_orders")
    return counted.select("target", "generated_at", "table_name", "checks", "broken", "violations", "exportable", *[f"reconciled_metrics.{m}" for m in metrics])


# --- incremental -------------------------------------------------------------------------------------


@query(
    "hwm_incremental",
    """WITH m AS (SELECT max(o_orderdate) AS m FROM orders WHERE o_orderdate < timestamp '1998-01-01') SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS processed,
    strftime((SELECT max(o_orderdate) FROM orders), '%Y-%m-%d') AS next_mark FROM orders, m WHERE o_orderdate > m""",
)
def hwm_incremental(spark, sf):
    orders = views.order_headers(spark, sf).select("order_id", "purchased_at")
    loaded = orders.filter(F.col("purchased_at") < "1998-01-01")
    mark = versions.high_water_mark(loaded, "purchased_at")
    batch = versions.above_mark(orders, "purchased_at", mark)
    advanced = versions.next_mark(batch, "purchased_at", "orders", mark).select("high_water_mark").scalar()
    return batch.select(
        "order_id", F.date_format("purchased_at", "yyyy-MM-dd").alias("processed"), F.date_format(advanced, "yyyy-MM-dd").alias("next_mark")
    )


@query(
    "upsert_merge",
    """WITH b AS (SELECT o_orderkey AS order_id, o_totalprice AS amount, 1 AS version FROM orders WHERE o_orderkey % 10 <> 0), c AS (SELECT o_orderkey AS order_id, o_totalprice + 1 AS amount, 2 AS version FROM orders WHERE o_orderkey % 7 = 0)
    SELECT coalesce(c.order_id, b.order_id) AS order_id, round(coalesce(c.amount, b.amount), 2) AS amount, coalesce(c.version, b.version) AS version FROM b FULL JOIN c ON b.order_id = c.order_id""",
)
def upsert_merge(spark, sf):
    orders = table(spark, sf, "orders")
    base = orders.filter(F.col("o_orderkey") % 10 != 0).select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), F.lit(1).alias("version"))
    changes = orders.filter(F.col("o_orderkey") % 7 == 0).select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") + 1).alias("amount"), F.lit(2).alias("version")
    )
    once = versions.upsert(base, changes, ["order_id"], "version")
    again = versions.upsert(once, changes, ["order_id"], "version")
    return again.withColumn("amount", F.round("amount", 2))


@query("backfill_range", f"SELECT year(o_orderdate)::integer AS order_year, count(*) AS orders, {dbl('sum(cast(o_totalprice as decimal(12,2)))')} AS amount FROM orders GROUP BY 1")
def backfill_range(spark, sf):
    """A table with wrong amounts in 1996 and 1997; only these two partitions are rewritten."""
    path = shared_dir(spark, "backfill") + "/orders"
    right = views.order_headers(spark, sf).select("order_id", "order_amount", F.year("purchased_at").alias("order_year"))
    wrong = right.withColumn("order_amount", F.when(F.col("order_year").isin(1996, 1997), F.lit(0).cast("decimal(12,2)")).otherwise(F.col("order_amount")))
    bronze.write_table(wrong, path, ["order_year"])
    versions.backfill(right, path, "order_year", 1996, 1997)
    return spark.read.parquet(path).groupBy("order_year").agg(F.count(F.lit(1)).alias("orders"), F.sum("order_amount").cast("double").alias("amount"))
