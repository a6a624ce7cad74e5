"""Reconciliation between layers and column tests on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = 0.01


def revenue_reconciliation(source: DataFrame, target: DataFrame) -> DataFrame:
    """Revenue sums of two layers side by side. Each layer is read once; the source sums enter
    the target row as a scalar subquery."""
    sums = source.agg(
        F.struct(
            F.sum("item_price").alias("p"), F.sum("freight_value").alias("f"), F.sum("total_item_value").alias("t")
        ).alias("s")
    ).scalar()
    out = target.agg(F.sum("item_price").alias("p"), F.sum("total_item_value").alias("t")).withColumn("s", sums)
    variance = F.col("t") - F.col("s.t")
    return out.select(
        F.col("s.p").cast("double").alias("source_item_revenue"),
        F.col("s.f").cast("double").alias("source_freight_revenue"),
        F.col("s.t").cast("double").alias("source_total_revenue"),
        F.col("p").cast("double").alias("target_item_revenue"),
        F.col("t").cast("double").alias("target_total_revenue"),
        variance.cast("double").alias("revenue_variance"),
        F.when(F.abs(variance) < EXACT, "EXACT_MATCH").otherwise("VARIANCE_DETECTED").alias("reconciliation_status"),
    )


def layer_account(entity: str, landed: DataFrame, checked: DataFrame, stored: DataFrame, rejected: DataFrame, weight: str | None = None) -> DataFrame:
    """Where the rows of a landed table went, counted in the tables as they are stored.

    Landed rows are duplicates or checked, checked ones valid or rejected. ``weight`` is the column of a folded table
    that says how many rows one row stands for. ``variance`` is what is missing (or too much), ``balanced`` whether
    nothing is.
    """
    rows = F.count(F.lit(1))
    valid = F.coalesce(F.sum(weight), F.lit(0)) if weight else rows
    counts = landed.agg(rows.alias("landed_rows")).select(
        F.lit(entity).alias("entity"),
        "landed_rows",
        checked.agg(rows.alias("n")).scalar().alias("checked_rows"),
        stored.agg(valid.alias("n")).scalar().alias("valid_rows"),
        rejected.agg(rows.alias("n")).scalar().alias("rejected_rows"),
    )
    variance, duplicates = F.col("checked_rows") - F.col("valid_rows") - F.col("rejected_rows"), F.col("landed_rows") - F.col("checked_rows")
    return counts.select(
        "entity",
        "landed_rows",
        duplicates.alias("duplicate_rows"),
        "valid_rows",
        "rejected_rows",
        variance.alias("variance"),
        ((variance == 0) & (duplicates >= 0)).alias("balanced"),
    )


def column_tests(df: DataFrame, key: list[str], not_null: list[str], non_negative: list[str]) -> DataFrame:
    """Violation counts of unique, not_null and non-negative tests in one pass.

    Rows are combined per key first, with the other violations summed along, so uniqueness and the
    rest share one scan and one shuffle.
    """
    flags = {f"not_null:{c}": F.col(c).isNull() for c in not_null}
    flags |= {f"non_negative:{c}": F.col(c) < 0 for c in non_negative}
    aliases = {name: f"_v{i}" for i, name in enumerate(flags)}
    grouped = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.when(cond, 1).otherwise(0)).alias(aliases[name]) for name, cond in flags.items()],
    )
    totals = grouped.agg(F.sum(F.col("_n") - 1).alias("_u"), *[F.sum(a).alias(a) for a in aliases.values()])
    unique = f"unique:{','.join(key)}"
    rows = [(unique, "_u"), *aliases.items()]
    entries = F.array(*[F.struct(F.lit(n).alias("test"), F.coalesce(F.col(c), F.lit(0)).alias("violations")) for n, c in rows])
    return totals.select(F.explode(entries).alias("e")).select(
        "e.test", "e.violations", (F.col("e.violations") == 0).alias("passed")
    )
