"""Comparison of two datasets, two periods or two members of a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pct_delta
from .ranking import half_split

MIN_ROWS = 4


def period_compare(df: DataFrame, moment: str, tie: str, value: str) -> DataFrame:
    """Earlier against later half of the rows; empty below four rows."""
    halves = half_split(df, moment, tie, value).filter(F.col("rows") >= MIN_ROWS)
    a, b = F.col("first_sum"), F.col("second_sum")
    return halves.select(
        a.cast("double").alias("previous"),
        b.cast("double").alias("current"),
        (b - a).cast("double").alias("difference"),
        pct_delta(a, b).alias("difference_pct"),
        (b >= a).alias("is_growth"),
    )


def quality_delta(before: DataFrame, after: DataFrame, numeric: list[str], dates: list[str]) -> DataFrame:
    """Score and issue changes between two snapshots of a table."""
    from .profile import quality_score

    fields = F.struct("quality_score", "missing_values", "duplicate_rows")
    a = quality_score(before, numeric, dates).select(fields.alias("a")).scalar()
    b = quality_score(after, numeric, dates).withColumn("_a", a)
    return b.select(
        F.col("_a.quality_score").alias("score_before"),
        F.col("quality_score").alias("score_after"),
        F.round(F.col("quality_score") - F.col("_a.quality_score"), 2).alias("score_delta"),
        (F.col("missing_values") - F.col("_a.missing_values")).alias("missing_delta"),
        (F.col("duplicate_rows") - F.col("_a.duplicate_rows")).alias("duplicate_delta"),
    )


# --- two datasets ----------------------------------------------------------------------------------

MEASURES = ["sum", "mean", "median", "min", "max", "std"]


def numeric_measures(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum, mean, median, min, max and deviation per column from one unpivoted fold."""
    from .ranking import column_quantiles, unpivot

    long = unpivot(df, columns).filter(F.col("value").isNotNull())
    folded = long.groupBy("column").agg(
        F.sum("value").alias("sum"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
    )
    medians = column_quantiles(df, columns, [0.5]).select("column", F.element_at("q", 1).alias("median"))
    return folded.join(medians, "column")


def dataset_compare(a: DataFrame, b: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Row counts and numeric measures of mapped columns side by side with their changes."""
    left = numeric_measures(a, list(mapping))
    right = numeric_measures(b.select(*[F.col(cb).alias(ca) for ca, cb in mapping.items()]), list(mapping))
    la = left.select("column", *[F.col(m).alias(f"{m}_a") for m in MEASURES])
    lb = right.select("column", *[F.col(m).alias(f"{m}_b") for m in MEASURES])
    counts = {"rows_a": a.agg(F.count(F.lit(1)).alias("n")).scalar(), "rows_b": b.agg(F.count(F.lit(1)).alias("n")).scalar()}
    out = la.join(lb, "column").withColumns(counts)
    return out.withColumns(
        {
            "rows_pct": pct_delta(F.col("rows_a"), F.col("rows_b")),
            "sum_diff": F.col("sum_b") - F.col("sum_a"),
            "sum_pct": pct_delta(F.col("sum_a"), F.col("sum_b")),
            "mean_pct": pct_delta(F.col("mean_a"), F.col("mean_b")),
        }
    )


QUALITY_FIELDS = [
    "quality_score",
    "completeness_score",
    "uniqueness_score",
    "validity_score",
    "consistency_score",
    "missing_values",
    "duplicate_rows",
    "outlier_count",
    "invalid_dates",
    "constant_columns",
]


def quality_compare(a: DataFrame, b: DataFrame, numeric: list[str], dates: list[str]) -> DataFrame:
    """One row per quality measure: value on both sides and the difference."""
    from .profile import quality_score

    left = quality_score(a, numeric, dates).select(F.struct(*QUALITY_FIELDS).alias("s")).scalar()
    right = quality_score(b, numeric, dates).withColumn("a", left)
    entries = [
        F.struct(
            F.lit(f).alias("measure"),
            F.col("a")[f].cast("double").alias("value_a"),
            F.col(f).cast("double").alias("value_b"),
            F.round(F.col(f).cast("double") - F.col("a")[f].cast("double"), 2).alias("delta"),
        )
        for f in QUALITY_FIELDS
    ]
    return right.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def record_diff(a: DataFrame, b: DataFrame, key_a: str, key_b: str, columns: list[tuple[str, str]], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Every key with its state: common, changed, new or removed, from one full outer join.

    Keys are compared as text and made unique first (first row by the stated order); values are
    compared as text with NULL equal to NULL.
    """
    from .dedup import keep_one

    def side(df: DataFrame, key: str, cols: list[str], order: list[str], tag: str) -> DataFrame:
        rows = df.filter(F.col(key).isNotNull())
        unique = keep_one(rows, [key], [F.col(c) for c in order])
        values = F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
        return unique.select(F.col(key).cast("string").alias("key"), values.alias(tag))

    left = side(a, key_a, [x for x, _ in columns], order_a, "a")
    right = side(b, key_b, [y for _, y in columns], order_b, "b")
    joined = left.join(right, "key", "full_outer")
    state = (
        F.when(F.col("b").isNull(), "removed")
        .when(F.col("a").isNull(), "new")
        .when(~F.col("a").eqNullSafe(F.col("b")), "changed")
        .otherwise("common")
    )
    return joined.select("key", state.alias("state"))


def record_diff_counts(diff: DataFrame) -> DataFrame:
    """Counts of a record diff; changed keys are common keys as well."""
    def n(*states: str) -> Column:
        return F.count(F.when(F.col("state").isin(*states), 1))

    common, keys_a = n("common", "changed"), n("common", "changed", "removed")
    return diff.agg(
        common.alias("common_count"),
        n("new").alias("new_count"),
        n("removed").alias("removed_count"),
        n("changed").alias("changed_count"),
        F.round(common * 100.0 / F.greatest(F.lit(1), keys_a), 1).alias("common_pct"),
    )


def category_shift(a: DataFrame, b: DataFrame, group_a: str, group_b: str, value_a: Column | None, value_b: Column | None) -> DataFrame:
    """Totals (or row counts) per category on both sides; categories meet by their text."""
    def side(df: DataFrame, group: str, value: Column | None, tag: str) -> DataFrame:
        amount = F.sum(value) if value is not None else F.count(F.lit(1))
        rows = df.filter(F.col(group).isNotNull())
        return rows.groupBy(F.col(group).cast("string").alias("category")).agg(amount.cast("double").alias(tag))

    joined = side(a, group_a, value_a, "va").join(side(b, group_b, value_b, "vb"), "category", "full_outer")
    x, y = F.coalesce("va", F.lit(0.0)), F.coalesce("vb", F.lit(0.0))
    status = F.when(F.col("va").isNull(), "New in B").when(F.col("vb").isNull(), "Only in A").otherwise("Common")
    return joined.select(
        "category", x.alias("value_a"), y.alias("value_b"), (y - x).alias("shift"), pct_delta(x, y).alias("growth_pct"), status.alias("status")
    )


def top_growing(shift: DataFrame, n: int = 3) -> DataFrame:
    return shift.orderBy(F.col("growth_pct").desc(), F.col("category")).limit(n)


def dimension_compare(df: DataFrame, group: str, member_a: str, member_b: str, value: str) -> DataFrame:
    """Two members of a dimension head to head from one conditional aggregate."""
    def of(member: str, tag: str) -> list[Column]:
        inside = F.col(group).cast("string") == member
        return [F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0)).alias(f"v{tag}"), F.count(F.when(inside, 1)).alias(f"n{tag}")]

    out = df.filter(F.col(group).cast("string").isin(member_a, member_b)).agg(*of(member_a, "a"), *of(member_b, "b"))
    va, vb = F.col("va").cast("double"), F.col("vb").cast("double")
    one = F.lit(1)
    return out.select(
        F.lit(member_a).alias("item_a"),
        F.lit(member_b).alias("item_b"),
        va.alias("value_a"),
        vb.alias("value_b"),
        F.col("na").alias("count_a"),
        F.col("nb").alias("count_b"),
        (va / F.greatest(one, F.col("na"))).alias("average_a"),
        (vb / F.greatest(one, F.col("nb"))).alias("average_b"),
        (F.col("va") - F.col("vb")).cast("double").alias("difference"),
        pct_delta(vb, va).alias("difference_pct"),
        F.when(va >= vb, member_a).otherwise(member_b).alias("leader"),
    )


def trend_overlay(a: DataFrame, b: DataFrame, moment_a: str, moment_b: str, value_a: str, value_b: str, label) -> DataFrame:
    """Totals per period of both sides next to each other; periods without rows do not appear."""
    def side(df: DataFrame, moment: str, value: str, tag: str) -> DataFrame:
        rows = df.filter(F.col(moment).isNotNull() & F.col(value).isNotNull())
        return rows.groupBy(label(moment).alias("period")).agg(F.sum(value).cast("double").alias(tag))

    return side(a, moment_a, value_a, "value_a").join(side(b, moment_b, value_b, "value_b"), "period", "full_outer")


# Change in percent that makes a metric fact important, score change worth a fact.
HIGH_IMPACT_PCT = 10.0
SCORE_CHANGE = 0.1


def comparison_facts(compared: DataFrame, quality: DataFrame, metrics: list[str], first: int | None = None) -> DataFrame:
    """Fact rows of a comparison: volume, all metrics (or the first few, for a short report), quality."""
    volume = compared.limit(1).filter(F.col("rows_a") != F.col("rows_b")).select(
        F.lit("volume").alias("type"), F.lit("rows").alias("subject"), (F.col("rows_b") - F.col("rows_a")).cast("double").alias("difference"),
        F.col("rows_pct").alias("change_pct"), F.lit("High").alias("impact"),
    )
    metric = compared.filter(F.col("column").isin(metrics[:first]) & (F.col("sum_diff") != 0)).select(
        F.lit("metric").alias("type"), F.col("column").alias("subject"), F.col("sum_diff").alias("difference"), F.col("sum_pct").alias("change_pct"),
        F.when(F.abs("sum_pct") > HIGH_IMPACT_PCT, "High").otherwise("Medium").alias("impact"),
    )
    score = quality.filter((F.col("measure") == "quality_score") & (F.abs("delta") >= SCORE_CHANGE)).select(
        F.lit("quality").alias("type"), F.col("measure").alias("subject"), F.col("delta").alias("difference"), pct_delta(F.col("value_a"), F.col("value_b")).alias("change_pct"),
        F.lit("Medium").alias("impact"),
    )
    return volume.unionByName(metric).unionByName(score)
