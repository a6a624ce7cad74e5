"""Data-quality firewall: declared rules split a table into valid rows and quarantine.

A rule states a condition that must be TRUE. FALSE and NULL both fail it. The flagged frame carries
the failed rule ids and reasons, and everything else (split, quarantine rows, counts) is derived
from it, so a table is evaluated once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDS = "_failed_rule_ids"
REASONS = "_failed_reasons"
QUARANTINE_COLUMNS = [
    "_quarantine_id",
    "_source_entity",
    "_dq_rule_id",
    "_dq_reason",
    "_quarantine_timestamp",
    "_rejection_date",
    "_processing_batch_id",
    "raw_payload",
]


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    condition: Column


def failed(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def flag(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the arrays of failed rule ids and reasons (empty for a valid row)."""
    if not rules:
        empty = F.array().cast("array<string>")
        return df.withColumns({IDS: empty, REASONS: empty})
    ids = [F.when(failed(r.condition), F.lit(r.id)) for r in rules]
    reasons = [F.when(failed(r.condition), F.lit(f"{r.id}: {r.description}")) for r in rules]
    return df.withColumns({IDS: F.array_compact(F.array(*ids)), REASONS: F.array_compact(F.array(*reasons))})


def valid(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.size(IDS) == 0).drop(IDS, REASONS)


def quarantine(flagged: DataFrame, entity: str, batch_id: str, rejected_at: str, payload: list[str] | None = None) -> DataFrame:
    """Rejected rows with audit columns.

    The id is a hash of entity, batch and payload: replaying a batch gives the same ids, so the
    quarantine can be overwritten or merged without doubling rows.
    """
    columns = payload or [c for c in flagged.columns if c not in (IDS, REASONS)]
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return (
        flagged.filter(F.size(IDS) > 0)
        .withColumn("raw_payload", body)
        .withColumns(
            {
                "_quarantine_id": F.sha2(F.concat_ws("||", F.lit(entity), F.lit(batch_id), "raw_payload"), 256),
                "_source_entity": F.lit(entity),
                "_dq_rule_id": F.array_join(IDS, "; "),
                "_dq_reason": F.array_join(REASONS, "; "),
                "_quarantine_timestamp": F.lit(rejected_at),
                "_rejection_date": F.lit(rejected_at[:10]),
                "_processing_batch_id": F.lit(batch_id),
            }
        )
        .drop(IDS, REASONS)
    )


def metrics(flagged: DataFrame, entity: str) -> DataFrame:
    """One row of counts from one aggregation."""
    bad = F.sum(F.when(F.size(IDS) > 0, 1).otherwise(0))
    total = F.count(F.lit(1))
    counted = flagged.agg(total.alias("input_count"), F.coalesce(bad, F.lit(0)).alias("quarantined_count"))
    return counted.select(
        F.lit(entity).alias("entity"),
        "input_count",
        (F.col("input_count") - F.col("quarantined_count")).alias("valid_count"),
        "quarantined_count",
        rate(F.col("quarantined_count"), F.col("input_count"), 2).alias("quarantine_pct"),
    )


def rate(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` rounded half up on decimals, 0 for an empty table."""
    exact = (part.cast("decimal(18,0)") * 100 / whole.cast("decimal(18,0)")).cast("decimal(24,10)")
    return F.when(whole > 0, F.round(exact, digits).cast("double")).otherwise(F.lit(0.0))


def rule_counts(flagged: DataFrame) -> DataFrame:
    """Rejections per rule: the arrays are exploded after the valid rows are gone."""
    return (
        flagged.filter(F.size(IDS) > 0)
        .select(F.explode(REASONS).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(F.substring_index("reason", ":", 1).alias("rule_id"), "reason", "violations")
    )


def report(parts: list[DataFrame]) -> DataFrame:
    """Metric rows of all entities plus a total row, which rollup adds in the same aggregation."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    out = rows.rollup("entity").agg(
        F.sum("input_count").alias("input_count"),
        F.sum("valid_count").alias("valid_count"),
        F.sum("quarantined_count").alias("quarantined_count"),
        F.grouping("entity").alias("is_total"),
    )
    total = F.col("is_total") == 1
    part, whole = F.col("quarantined_count"), F.col("input_count")
    return out.select(
        F.when(total, "TOTAL").otherwise(F.col("entity")).alias("entity"),
        "input_count",
        "valid_count",
        "quarantined_count",
        F.when(total, rate(part, whole, 4)).otherwise(rate(part, whole, 2)).alias("quarantine_pct"),
    )


class GateError(RuntimeError):
    """A quality gate did not pass."""


def gates(values: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Compare a one-row frame of values with limits.

    ``limits`` maps a column to (``max`` | ``min`` | ``equal``, limit); the result has one row per
    gate: gate, value, limit, passed.
    """
    tests = {"max": lambda v, m: v <= m, "min": lambda v, m: v >= m, "equal": lambda v, m: v == m}
    rows = []
    for name, (kind, limit) in limits.items():
        value = F.col(name).cast("double")
        rows.append(
            F.struct(
                F.lit(name).alias("gate"),
                value.alias("value"),
                F.lit(float(limit)).alias("limit"),
                F.coalesce(tests[kind](value, F.lit(float(limit))), F.lit(False)).alias("passed"),
            )
        )
    return values.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def enforce(gate_rows: DataFrame) -> None:
    """Raise when any gate failed. The gate table has one row per gate, so it is small."""
    broken = [r.gate for r in gate_rows.filter(~F.col("passed")).select("gate").collect()]
    if broken:
        raise GateError(f"quality gates failed: {', '.join(sorted(broken))}")
