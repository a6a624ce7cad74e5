"""Audit log analytics and operational checks over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions.text import SECRET_PATTERNS, mask_secrets
from ..operators import audit, ops, trees
from ..session import materialize
from .registry import query, table
from .sqlbits import big, leaf_sql, tree_sql

SEVERITY = {"error": "HIGH", "signup": "WARNING", "purchase": "INFO", "click": "INFO", "view": "INFO"}
SEVERITY_SQL = "CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END"


def log(spark, sf):
    events = views.order_events(spark, sf)
    mapping = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return events.withColumn("severity", mapping[F.col("event_type")])


@query(
    "audit_search",
    f"SELECT event_id, user_id, event_type, {SEVERITY_SQL} AS severity FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def audit_search(spark, sf):
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    found = audit.search(log(spark, sf), {"severity": "HIGH", "event_type": "error", "user_id": None}, newest, 100)
    return found.select("event_id", "user_id", "event_type", "severity")


@query(
    "audit_summary",
    f"""SELECT count(*) AS total_events, count(CASE WHEN {SEVERITY_SQL} = 'INFO' THEN 1 END) AS severity_info, count(CASE WHEN {SEVERITY_SQL} = 'WARNING' THEN 1 END) AS severity_warning,
    count(CASE WHEN {SEVERITY_SQL} = 'HIGH' THEN 1 END) AS severity_high, 0::bigint AS severity_critical, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures,
    count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS browsing FROM events""",
)
def audit_summary(spark, sf):
    return audit.summary(log(spark, sf), ["INFO", "WARNING", "HIGH", "CRITICAL"], {"failures": ["error"], "browsing": ["click", "view"]})


FIELDS = ["event_id", "event_type", "user_id", "props"]


@query("hash_chain_check")
def hash_chain_check(spark, sf):
    """A chained log per user and day; records whose number is a multiple of 997 are altered later."""
    events = views.order_events(spark, sf).select(*FIELDS, "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    chained = audit.chain_log(events, ["user_id", "day"], ["ts", "event_id"], FIELDS)
    tampered = chained.withColumn("event_type", F.when(F.col("event_id") % 997 == 0, F.lit("forged")).otherwise(F.col("event_type")))
    return audit.verify_chain(tampered, ["user_id", "day"], FIELDS)


@query(
    "log_tree_check",
    f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS node FROM events),
    {tree_sql(f"SELECT user_id, node, {leaf_sql(['event_id::varchar', 'event_type', 'user_id::varchar', 'props'])} AS digest FROM placed", "user_id", 16)},
    forged AS (SELECT user_id, count(*) AS records, count(CASE WHEN event_id % 997 = 0 THEN 1 END) AS broken, min(CASE WHEN event_id % 997 = 0 THEN node END) AS first_broken FROM placed GROUP BY user_id)
    SELECT user_id, digest AS root, records, broken, first_broken, broken = 0 AS valid FROM t8 JOIN forged USING (user_id)""",
)
def log_tree_check(spark, sf):
    """A hash tree per user over the whole log; records whose number is a multiple of 997 are altered later."""
    events = views.order_events(spark, sf).select(*FIELDS, "ts", F.date_trunc("day", "ts").alias("day"))
    sealed = materialize(trees.seal_log(events, ["user_id"], "day", ["ts", "event_id"]), "sealed-log")
    stored = trees.log_tree(sealed, ["user_id"], FIELDS, 16)
    forged = sealed.withColumn("event_type", F.when(F.col("event_id") % 997 == 0, F.lit("forged")).otherwise(F.col("event_type")))
    return trees.verify_log(forged, stored, ["user_id"], FIELDS, 16)


@query(
    "burst_detect",
    """WITH t AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS trailing_count,
    count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) >= 3 AS breached FROM t""",
)
def burst_detect(spark, sf):
    return audit.bursts(views.order_events(spark, sf).select("event_id", "user_id", "ts"), ["user_id"], "ts", 21600, 3).drop("ts")


def limiter_sql(keys: str, limit: int, seconds: int) -> str:
    """The limiter by recursion: one step takes the next request of every key."""
    same = " AND ".join(f"r.{k} = e.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT event_id, event_type, user_id, n, [t] AS accepted, true AS allowed FROM e WHERE n = 1
      UNION ALL SELECT event_id, event_type, user_id, n, CASE WHEN len(kept) < {limit} THEN list_append(kept, t) ELSE kept END, len(kept) < {limit}
      FROM (SELECT e.event_id, e.event_type, e.user_id, e.n, e.t, list_filter(r.accepted, lambda x: x > e.t - {seconds * 1_000_000}) AS kept FROM r JOIN e ON {same} AND e.n = r.n + 1))
    SELECT event_id, event_type, allowed FROM r"""


@query("rate_limit_replay", limiter_sql("event_type", 10, 3600))
def rate_limit_replay(spark, sf):
    """Few keys, each of them busy: the replay goes by blocks of time."""
    events = views.order_events(spark, sf).select("event_id", "event_type", "ts")
    return audit.rate_limit(events, ["event_type"], "ts", "event_id", 10, 3600).select("event_id", "event_type", "allowed")


@query("rate_limit_by_user", limiter_sql("event_type, user_id", 2, 5 * 86400))
def rate_limit_by_user(spark, sf):
    """The limiter keyed by action and user, two in five days."""
    events = views.order_events(spark, sf).select("event_id", "event_type", "user_id", "ts")
    return audit.rate_limit(events, ["event_type", "user_id"], "ts", "event_id", 2, 5 * 86400).select("event_id", "event_type", "allowed")


@query(
    "lockout_replay",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
    r AS (SELECT event_id, user_id, t, n, t AS first, 1::bigint AS failed_count FROM e WHERE n = 1
      UNION ALL SELECT e.event_id, e.user_id, e.t, e.n, CASE WHEN e.t - r.first > 86400000000 THEN e.t ELSE r.first END, CASE WHEN e.t - r.first > 86400000000 THEN 1 ELSE r.failed_count + 1 END
      FROM r JOIN e ON r.user_id = e.user_id AND e.n = r.n + 1)
    SELECT event_id, user_id, failed_count, CASE WHEN failed_count >= 3 THEN strftime(make_timestamp(t + 86400000000), '%Y-%m-%d %H:%M:%S.%f') END AS locked_until FROM r""",
)
def lockout_replay(spark, sf):
    failed = views.order_events(spark, sf).filter(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    out = audit.lockouts(failed, ["user_id"], "ts", "event_id", 3, 86400)
    return out.select("event_id", "user_id", "failed_count", F.date_format("locked_until", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("locked_until"))


def mask_sql(expr: str) -> str:
    for pattern, target in SECRET_PATTERNS:
        replacement = target.replace("{", "\\").replace("}", "")
        expr = f"regexp_replace({expr}, '{pattern.replace(chr(39), chr(39) * 2)}', '{replacement}', 'g')"
    return expr


LEAK = "CASE doc_id % 4 WHEN 0 THEN ' postgresql://bob:pw{0}@db:5432/x ' WHEN 1 THEN ' api_key = \"abc{0}\" ' WHEN 2 THEN ' Authorization: bearer abcdefghijklmnop{0} ' ELSE ' sk-abcdefghijklmnop{0} ' END"
LEAK_SQL = LEAK.replace("{0}", "' || doc_id || '")


@query("mask_secrets", f"SELECT doc_id, {mask_sql('text || ' + LEAK_SQL)} AS masked FROM documents")
def mask(spark, sf):
    key = F.col("doc_id").cast("string")

    def leak(before: str, after: str):
        return F.concat(F.lit(before), key, F.lit(after))

    secret = (
        F.when(F.col("doc_id") % 4 == 0, leak(" postgresql://bob:pw", "@db:5432/x "))
        .when(F.col("doc_id") % 4 == 1, leak(' api_key = "abc', '" '))
        .when(F.col("doc_id") % 4 == 2, leak(" Authorization: bearer abcdefghijklmnop", " "))
        .otherwise(leak(" sk-abcdefghijklmnop", " "))
    )
    return table(spark, sf, "documents").select("doc_id", mask_secrets(F.concat(F.col("text"), secret)).alias("masked"))


@query("retention_filter", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE cast(ts as date) >= (SELECT cast(max(ts) as date) FROM events) - 10")
def retention_filter(spark, sf):
    events = views.order_events(spark, sf).withColumn("day", F.to_date("ts"))
    newest = events.agg(F.max("day").alias("d")).scalar()
    kept = audit.retain(events, "day", newest, 10)
    return kept.select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(
    "freshness_sla",
    """WITH l AS (SELECT CASE event_type WHEN 'view' THEN 'bronze' WHEN 'click' THEN 'silver' WHEN 'purchase' THEN 'gold' ELSE 'streaming' END AS layer, ts, event_id, event_type FROM events),
    n AS (SELECT max(ts) AS ref FROM events), g AS (SELECT layer, max(ts) AS last_run FROM l GROUP BY 1),
    r AS (SELECT w.layer, last_run, round((epoch_us(ref) - epoch_us(last_run)) / 60000000.0::double, 1) AS latency_minutes, CASE WHEN last_run IS NULL THEN 'MISSING' WHEN epoch_us(ref) - epoch_us(last_run) <= 3600000000 THEN 'FRESH' ELSE 'STALE' END AS status
      FROM (SELECT unnest(['bronze', 'silver', 'gold', 'streaming']) AS layer) w LEFT JOIN g USING (layer), n)
    SELECT layer, strftime(last_run, '%Y-%m-%d %H:%M:%S') AS last_run, latency_minutes, status,
    CASE WHEN (SELECT count(*) FROM r WHERE status = 'MISSING') > 0 THEN 'RED' WHEN (SELECT count(*) FROM r WHERE status = 'STALE') > 0 THEN 'YELLOW' ELSE 'GREEN' END AS sla_tier FROM r""",
)
def freshness_sla(spark, sf):
    events = views.order_events(spark, sf)
    layer = F.when(F.col("event_type") == "view", "bronze").when(F.col("event_type") == "click", "silver").when(F.col("event_type") == "purchase", "gold").otherwise("streaming")
    history = events.select(layer.alias("layer"), F.col("ts").alias("finished_at"), F.lit("SUCCESS").alias("status"), F.lit(0.5).alias("quarantine_pct"))
    reference = events.agg(F.max("ts").alias("t")).scalar()
    out = ops.freshness(history, ["bronze", "silver", "gold", "streaming"], reference)
    return out.select("layer", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"), "latency_minutes", "status", "sla_tier")


@query(
    "layer_audit",
    """WITH g AS (SELECT event_type AS layer, count(*) AS rows FROM events GROUP BY 1) SELECT layer, coalesce(rows, 0) AS rows, CASE WHEN rows > 0 THEN 'PASSED' ELSE 'MISSING' END AS status, 'MISSING' AS overall
    FROM (SELECT unnest(['view', 'click', 'purchase', 'refund']) AS layer) LEFT JOIN g USING (layer)""",
)
def layer_audit(spark, sf):
    found = table(spark, sf, "events").select(F.col("event_type").alias("layer"))
    return ops.presence(found, ["view", "click", "purchase", "refund"])
