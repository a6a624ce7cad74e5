"""Freshness and presence of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLA_MINUTES = 60.0
QUARANTINE_LIMIT_PCT = 1.0


def freshness(history: DataFrame, layers: list[str], reference: Column) -> DataFrame:
    """Last run, age and state of every expected layer, and the overall tier.

    RED: a layer has no run or its last run failed. YELLOW: a last run is older than the limit or a
    layer rejected too much. GREEN otherwise. ``history``: layer, finished_at, status, quarantine_pct.
    """
    last = history.groupBy("layer").agg(F.max_by(F.struct("finished_at", "status", "quarantine_pct"), F.struct("finished_at", "status")).alias("l"))
    expected = history.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in layers])).alias("layer"))
    joined = expected.join(last, "layer", "left")
    age = (F.unix_micros(reference) - F.unix_micros("l.finished_at")) / 60_000_000.0
    state = F.when(F.col("l").isNull(), "MISSING").when(F.col("l.status") != "SUCCESS", "FAILED").when(age <= SLA_MINUTES, "FRESH").otherwise("STALE")
    rows = joined.select("layer", F.col("l.finished_at").alias("last_run"), F.round(age, 1).alias("latency_minutes"), F.col("l.quarantine_pct").alias("quarantine_pct"), state.alias("status"))
    worst = F.max(
        F.when(F.col("status").isin("MISSING", "FAILED"), 2).when((F.col("status") == "STALE") | (F.col("quarantine_pct") >= QUARANTINE_LIMIT_PCT), 1).otherwise(0)
    )
    tier = rows.agg(worst.alias("w")).scalar()
    return rows.withColumn("sla_tier", F.when(tier == 2, "RED").when(tier == 1, "YELLOW").otherwise("GREEN"))


def presence(found: DataFrame, expected: list[str]) -> DataFrame:
    """Expected layers against the rows found for them: PASSED or MISSING, and the overall result."""
    counts = found.groupBy("layer").agg(F.count(F.lit(1)).alias("rows"))
    wanted = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in expected])).alias("layer"))
    rows = wanted.join(counts, "layer", "left").select("layer", F.coalesce("rows", F.lit(0)).alias("rows"))
    missing = rows.agg(F.count(F.when(F.col("rows") == 0, 1)).alias("m")).scalar()
    return rows.select(
        "layer", "rows", F.when(F.col("rows") > 0, "PASSED").otherwise("MISSING").alias("status"), F.when(missing == 0, "PASSED").otherwise("MISSING").alias("overall")
    )
