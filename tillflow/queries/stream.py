"""Streaming queries over the event log and their batch twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import raw, views
from ..functions.keys import surrogate_key
from ..operators import rules
from ..session import shared_dir
from ..streaming import orders as so
from .registry import query, table
from .sqlbits import ITEMS, LINES, big, dbl, mean_money

TS = "'%Y-%m-%d %H:%M:%S'"

EV = """ev0 AS (SELECT * FROM (SELECT *, unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS cp FROM events)),
ev AS (SELECT event_id AS k, event_id % 59 <> 0 AS readable, CASE WHEN event_id % 59 <> 0 THEN cast(event_id as varchar) END AS event_id, date_trunc('second', ts) AS event_timestamp,
  CASE WHEN event_id % 41 <> 0 AND event_id % 59 <> 0 THEN user_id || '-' || (event_id // 3) END AS order_id, cast(event_id % 3 + 1 as integer) AS order_item_id,
  cast(CASE WHEN event_id % 47 = 0 THEN -cast(value as decimal(12,2)) - 1 ELSE cast(value as decimal(12,2)) END as decimal(12,2)) AS price, cast(event_id % 7 as decimal(12,2)) AS freight_value,
  CASE WHEN event_id % 53 = 0 THEN 0 ELSE cast(event_id % 3 + 1 as integer) END AS quantity, event_type AS order_status, event_id % 43 <> 0 AS version_ok FROM ev0),
evf AS (SELECT *, cast(price + freight_value as decimal(12,2)) AS total_amount, readable AND order_id IS NOT NULL AND price >= 0 AND quantity >= 1 AND version_ok AS ok FROM ev),
evd AS (SELECT DISTINCT ON (event_id) * FROM evf WHERE ok)"""


def log_stream(spark, sf):
    """The event log as a file stream; a broker source would replace only this function."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def messages(spark, sf, streaming=False):
    source = log_stream(spark, sf) if streaming else table(spark, sf, "events")
    return raw.order_event_messages(source)


def checked(spark, sf, streaming=False):
    return so.check(so.parse(messages(spark, sf, streaming)))


def batch_events(spark, sf):
    return so.deduplicate(rules.valid(checked(spark, sf)))


def sink(spark, stream, name, partition_by=None):
    root = shared_dir(spark, name)
    so.run_to_parquet(stream, f"{root}/data", f"{root}/checkpoint", partition_by)
    return spark.read.parquet(f"{root}/data")


def clock(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(
    "fact_to_events",
    f"""WITH {LINES} SELECT sha256(cast(order_id as varchar) || '||' || cast(order_item_id as varchar)) AS event_id, strftime(purchased_at, {TS}) AS event_timestamp, cast(order_id as varchar) AS order_id, order_item_id,
    sha256(cast(customer_id as varchar) || '||v1') AS customer_id, {dbl('item_price')} AS price, {dbl('freight_value')} AS freight_value, order_status FROM lines""",
)
def fact_to_events(spark, sf):
    lines = views.order_items(spark, sf).join(views.order_headers(spark, sf), "order_id")
    fact = lines.select(
        "order_id",
        "order_item_id",
        surrogate_key(F.col("customer_id"), F.lit("v1")).alias("customer_key"),
        surrogate_key("product_id").alias("product_key"),
        surrogate_key("seller_id").alias("seller_key"),
        F.col("purchased_at").alias("order_purchase_timestamp"),
        "item_price",
        "freight_value",
        "order_item_quantity",
        "order_status",
    )
    back = so.parse(so.fact_to_events(fact))
    return back.select(
        "event_id",
        clock("event_timestamp").alias("event_timestamp"),
        "order_id",
        "order_item_id",
        "customer_id",
        F.col("price").cast("double").alias("price"),
        F.col("freight_value").cast("double").alias("freight_value"),
        "order_status",
    )


def windowed_sql(starts: str, keys: str) -> str:
    return f"""SELECT strftime(w, {TS}) AS window_start, strftime(w + INTERVAL 10 MINUTE, {TS}) AS window_end, {keys} count(*) AS events_count, count(DISTINCT order_id) AS unique_orders_count,
    {big('sum(quantity)')} AS total_units_sold, {dbl('sum(price)')} AS total_product_revenue, {dbl('sum(freight_value)')} AS total_freight_revenue, {dbl('sum(total_amount)')} AS total_gross_revenue,
    {mean_money('sum(price)', 'count(*)')} AS avg_item_price, {mean_money('sum(total_amount)', 'count(DISTINCT order_id)')} AS avg_order_value FROM {starts}"""


SLIDES = "(SELECT *, unnest([time_bucket(INTERVAL 5 MINUTE, event_timestamp), time_bucket(INTERVAL 5 MINUTE, event_timestamp) - INTERVAL 5 MINUTE]) AS w FROM evd)"
TUMBLES = "(SELECT *, time_bucket(INTERVAL 10 MINUTE, event_timestamp) AS w FROM evd)"


def shown(df):
    return df.withColumns({"window_start": clock("window_start"), "window_end": clock("window_end")})


@query("sliding_batch", f"WITH {EV} {windowed_sql(SLIDES, 'order_status,')} GROUP BY w, order_status")
def sliding_batch(spark, sf):
    return shown(so.sliding(batch_events(spark, sf)))


@query("tumbling_batch", f"WITH {EV} {windowed_sql(TUMBLES, '')} GROUP BY w")
def tumbling_batch(spark, sf):
    return shown(so.tumbling(batch_events(spark, sf)))


KPI_SQL = f"""WITH {EV} SELECT (SELECT count(*) FROM evf) AS input_events, count(*) AS valid_events, (SELECT count(*) FROM evf WHERE NOT coalesce(ok, false)) AS quarantined_events,
  (SELECT count(*) FROM evf WHERE ok) - count(*) AS duplicate_events, {dbl('sum(total_amount)')} AS gross_revenue, count(DISTINCT order_id) AS unique_orders, {big('sum(quantity)')} AS units_sold,
  {mean_money('sum(total_amount)', 'count(DISTINCT order_id)')} AS average_order_value FROM evd"""


@query("stream_kpis_batch", KPI_SQL)
def stream_kpis_batch(spark, sf):
    return so.kpis(checked(spark, sf))


@query(
    "stream_parse",
    f"""WITH {EV} SELECT event_id, CASE WHEN readable THEN strftime(event_timestamp, {TS}) END AS event_timestamp, order_id, CASE WHEN readable THEN {dbl('price')} END AS price,
    CASE WHEN readable THEN {dbl('total_amount')} END AS total_amount, CASE WHEN readable THEN strftime(event_timestamp, '%Y-%m') END AS order_year_month FROM evf""",
)
def stream_parse(spark, sf):
    out = sink(spark, so.parse(messages(spark, sf, True)), "stream_parse")
    return out.select(
        "event_id",
        clock("event_timestamp").alias("event_timestamp"),
        "order_id",
        F.col("price").cast("double").alias("price"),
        F.col("total_amount").cast("double").alias("total_amount"),
        "order_year_month",
    )


@query("stream_dq_split", f"WITH {EV} SELECT coalesce(ok, false) AS is_valid, count(*) AS events FROM evf GROUP BY 1")
def stream_dq_split(spark, sf):
    out = sink(spark, checked(spark, sf, True), "stream_dq")
    return out.groupBy((F.size(rules.IDS) == 0).alias("is_valid")).agg(F.count(F.lit(1)).alias("events"))


@query("stream_dedup", f"WITH {EV} SELECT event_id, order_id, {dbl('total_amount')} AS total_amount FROM evd")
def stream_dedup(spark, sf):
    stream = so.deduplicate(rules.valid(checked(spark, sf, True)))
    out = sink(spark, stream.select("event_id", "event_timestamp", "order_id", "total_amount"), "stream_dedup")
    return out.select("event_id", "order_id", F.col("total_amount").cast("double").alias("total_amount"))


def last_parts(spark, sf, name, slide, keys):
    """Update mode: every batch writes the (window, order) parts it changed; the last state of each counts."""
    root = shared_dir(spark, name)
    parts = so.order_parts(so.deduplicate(rules.valid(checked(spark, sf, True))), slide, keys)
    so.run_batches(parts, lambda df, batch_id: so.overwrite_batch(df, f"{root}/data", batch_id), f"{root}/checkpoint", "update")
    newest = W.partitionBy("w", "order_id", *keys).orderBy(F.col("batch_id").desc())
    return spark.read.parquet(f"{root}/data").withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1)


@query("stream_sliding", f"WITH {EV} {windowed_sql(SLIDES, 'order_status,')} GROUP BY w, order_status")
def stream_sliding(spark, sf):
    return shown(so.fold_parts(last_parts(spark, sf, "stream_sliding", so.SLIDE, ["order_status"]), ["order_status"]))


@query("stream_tumbling", f"WITH {EV} {windowed_sql(TUMBLES, '')} GROUP BY w")
def stream_tumbling(spark, sf):
    return shown(so.fold_parts(last_parts(spark, sf, "stream_tumbling", so.WINDOW, []), []))


@query("stream_foreach_batch", f"WITH {EV}, k AS ({KPI_SQL.split(EV)[1]}) SELECT valid_events AS silver_rows, quarantined_events AS quarantine_rows, gross_revenue, unique_orders FROM k")
def stream_foreach_batch(spark, sf):
    root = shared_dir(spark, "stream_batches")
    so.run_batches(messages(spark, sf, True), so.micro_batch(root), f"{root}/checkpoint")
    report = spark.read.parquet(f"{root}/report")
    rejected = spark.read.parquet(f"{root}/quarantine").agg(F.count(F.lit(1))).scalar()
    silver = spark.read.parquet(f"{root}/silver").agg(F.count(F.lit(1))).scalar()
    return report.agg(F.sum("gross_revenue").alias("gross_revenue"), F.sum("unique_orders").alias("unique_orders")).select(
        silver.alias("silver_rows"), rejected.alias("quarantine_rows"), "gross_revenue", "unique_orders"
    )


@query("stream_sinks", f"WITH {EV} SELECT strftime(event_timestamp, '%Y-%m') AS order_year_month, count(*) AS events, {dbl('sum(total_amount)')} AS gross_revenue FROM evd GROUP BY 1")
def stream_sinks(spark, sf):
    stream = so.deduplicate(rules.valid(checked(spark, sf, True)))
    out = sink(spark, stream, "stream_sinks", ["order_year_month"])
    return out.groupBy(F.col("order_year_month").cast("string").alias("order_year_month")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("total_amount").cast("double").alias("gross_revenue")
    )


@query("stream_kpis", KPI_SQL)
def stream_kpis(spark, sf):
    root = shared_dir(spark, "stream_kpis")

    def handle(batch, batch_id):
        so.overwrite_batch(so.kpis(so.check(so.parse(batch))), f"{root}/data", batch_id)

    so.run_batches(messages(spark, sf, True), handle, f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/data").drop("batch_id")


def two_arrivals(spark, sf, root, run):
    """Write the log in two arrivals (the second brings some old events) and run after each."""
    log = table(spark, sf, "events")
    first = (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_id") % 100 != 0)
    log.filter(first).write.mode("append").parquet(f"{root}/log")
    run()
    log.filter(~first).write.mode("append").parquet(f"{root}/log")
    run()


@query(
    "stream_late_route",
    """WITH f AS (SELECT *, event_id % 59 = 0 AS broken, date_trunc('second', ts) AS t, ts < timestamp '2024-01-20' AND event_id % 100 <> 0 AS first_batch FROM events),
    m AS (SELECT max(t) AS newest FROM f WHERE first_batch AND NOT broken)
    SELECT CASE WHEN broken THEN 'undated' WHEN NOT first_batch AND t < newest - INTERVAL 600 SECOND THEN 'late' ELSE 'on_time' END AS route, count(*) AS events
    FROM (SELECT *, unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS cp FROM f), m GROUP BY 1""",
)
def stream_late_route(spark, sf):
    """Every message takes one of three routes, so their counts add up to all messages."""
    root = shared_dir(spark, "stream_late")

    def run():
        log = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{root}/log")
        so.run_batches(so.parse(raw.order_event_messages(log)), so.route_late(root), f"{root}/checkpoint")

    two_arrivals(spark, sf, root, run)
    routes = [spark.read.parquet(f"{root}/{r}").select(F.lit(r).alias("route")) for r in ("late", "on_time", "undated")]
    return routes[0].unionByName(routes[1]).unionByName(routes[2]).groupBy("route").agg(F.count(F.lit(1)).alias("events"))


@query("stream_restart", "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY 1")
def stream_restart(spark, sf):
    """Same checkpoint, growing input, one extra run at the end: nothing is written twice."""
    root = shared_dir(spark, "stream_restart")

    def run():
        log = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{root}/log")
        so.run_to_parquet(log, f"{root}/data", f"{root}/checkpoint")

    two_arrivals(spark, sf, root, run)
    run()
    out = spark.read.parquet(f"{root}/data")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("distinct_events"))


#: The log spans a month and arrives in disorder here, so copies are held that long.
DELAY = "60 days"


def three_arrivals(spark, sf, name):
    """The messages of the log in three arrivals, in disorder; the second of two copies comes one arrival later or earlier."""
    root = shared_dir(spark, name)
    copies = messages(spark, sf).groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.explode(F.expr("sequence(0, cast(n as int) - 1)")))
    copies.withColumn("arrival", F.pmod(F.xxhash64("value") + F.col("c"), F.lit(3))).select("value", "arrival").write.partitionBy("arrival").parquet(f"{root}/sent")
    for arrival in range(3):
        stored = spark.read.schema("value string, arrival bigint").parquet(f"{root}/sent")
        stored.filter(F.col("arrival") == arrival).select("value").write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema("value string").parquet(f"{root}/log")
        so.run_batches(so.changes(so.check(so.parse(stream)), DELAY), so.write_changes(root), f"{root}/checkpoint", "update")
    return root


@query("stream_kpis_across", KPI_SQL)
def stream_kpis_across(spark, sf):
    root = three_arrivals(spark, sf, "stream_kpis_across")
    return so.merged_kpis(spark.read.parquet(f"{root}/orders"), spark.read.parquet(f"{root}/counts"))


@query("stream_sliding_across", f"WITH {EV} {windowed_sql(SLIDES, 'order_status,')} GROUP BY w, order_status")
def stream_sliding_across(spark, sf):
    root = three_arrivals(spark, sf, "stream_sliding_across")
    return shown(so.merged_sliding(spark.read.parquet(f"{root}/sliding")))
