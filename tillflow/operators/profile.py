"""Profiles, outliers, invalid dates and quality scores of any table.

Distinct values of all columns come from one read: cells become (column, value), combined on the map
side, so what is shuffled is one entry per distinct value and task. Long texts enter as their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .ranking import column_quantiles, unpivot
from .rules import rate

IQR_FACTOR = 1.5
MIN_OUTLIER_VALUES = 8
#: Bounds the cells that one row turns into.
COLUMNS_PER_READ = 32

# Weights of the four pillars, their penalties and the rating limits.
WEIGHTS = {"completeness": 0.35, "uniqueness": 0.30, "validity": 0.20, "consistency": 0.15}
OUTLIER_PENALTY, CONSTANT_PENALTY = 1.5, 2.0
MISSING_PENALTY, DATE_PENALTY = 0.4, 2.0
RATINGS = [(95.0, "EXCELLENT"), (85.0, "GOOD"), (70.0, "FAIR")]
REPORT_RATINGS = [(95.0, "EXCELLENT"), (80.0, "GOOD"), (60.0, "WARNING")]
NULL_TOKENS = ["", "null", "none", "nan"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _value_key(name: str, kind: str) -> str:
    """SQL of a text that is equal for equal values of one column, and for those only.

    Long texts enter as their hash, whose 64 characters no text kept as it is has; 0.0 and -0.0 are one value.
    """
    c = "`" + name.replace("`", "``") + "`"
    if kind == "string":
        return f"if(octet_length({c}) < 64, {c}, sha2({c}, 256))"
    if kind == "binary":
        return f"sha2({c}, 256)"
    if kind in ("float", "double"):
        return f"cast(cast({c} AS double) + 0.0D AS string)"
    if kind == "timestamp":
        return f"cast(unix_micros({c}) AS string)"
    if kind.startswith(("array", "struct", "map")):
        return f"sha2(to_json({c}, map('ignoreNullFields', 'false')), 256)"
    return f"cast({c} AS string)"


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, nulls and distinct values per column, from one read of the table per ``COLUMNS_PER_READ`` columns.

    Cells become (column, value) and are combined on the map side: what is shuffled is one entry per distinct value
    and task, whatever the number of rows that share it. The frame should be stored (see ``materialize``) when much
    work stands behind it.
    """
    kinds = dict(df.dtypes)
    names = list(columns or df.columns)
    out = None
    for at in range(0, len(names), COLUMNS_PER_READ):
        cells = [f"named_struct('column', {at + i}, 'v', {_value_key(c, kinds[c])})" for i, c in enumerate(names[at : at + COLUMNS_PER_READ])]
        counted = df.selectExpr(f"inline(array({', '.join(cells)}))").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        rows = counted.groupBy("column").agg(
            F.sum("n").alias("row_count"), F.expr("coalesce(sum(if(v IS NULL, n, 0)), 0)").alias("null_count"), F.count("v").alias("unique_count")
        )
        out = rows if out is None else out.unionByName(rows)
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("column") + 1)
    return out.withColumn("column", named)


def light_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells from one aggregation without a shuffle of values."""
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    out = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"))
    width = len(df.columns)
    cells = F.col("row_count") * width
    return out.select(
        "row_count",
        F.lit(width).alias("col_count"),
        "missing_cells",
        rate(F.col("missing_cells"), cells, 2).alias("missing_pct"),
        rate(cells - F.col("missing_cells"), cells, 2).alias("completeness_score"),
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Row count, rows beyond the first of equal rows, and their percentage."""
    keys = []
    for f in df.schema.fields:
        c = F.col(f.name)
        keys.append((F.sha2(c, 256) if f.dataType.simpleString() == "string" else c).alias(f.name))
    grouped = df.select(*keys).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    out = grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")
    )
    return out.withColumn("duplicate_pct", rate(F.col("duplicate_rows"), F.col("row_count"), 4))


def outlier_bounds(df: DataFrame, columns: list[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Exact quartile fences per column: column, n, iqr, lower, upper."""
    q = column_quantiles(df, columns, [0.25, 0.75])
    q25, q75 = F.element_at("q", 1), F.element_at("q", 2)
    iqr = q75 - q25
    return q.select(
        "column", "n", iqr.alias("iqr"), F.round(q25 - factor * iqr, 9).alias("lower"), F.round(q75 + factor * iqr, 9).alias("upper")
    )


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values outside the fences per column (eight values and a spread needed).

    The fences have one row per column, so they are broadcast to the scan.
    """
    fences = outlier_bounds(df, columns).filter((F.col("n") >= MIN_OUTLIER_VALUES) & (F.col("iqr") > 0))
    long = unpivot(df, columns).filter(F.col("value").isNotNull())
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    marked = long.join(F.broadcast(fences), "column").groupBy("column", "n", "lower", "upper").agg(
        F.sum(F.when(outside, 1).otherwise(0)).alias("outlier_count")
    )
    return marked.select(
        "column",
        F.col("n").alias("value_count"),
        "outlier_count",
        rate(F.col("outlier_count"), F.col("n"), 2).alias("outlier_pct"),
        F.round("lower", 4).alias("lower_bound"),
        F.round("upper", 4).alias("upper_bound"),
    ).filter(F.col("outlier_count") > 0)


def bad_date(c: str) -> Column:
    return F.col(c).isNotNull() & F.try_to_timestamp(F.col(c).cast("string")).isNull()


def invalid_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null texts that do not parse as a date, per column."""
    sums = [F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.sum(F.when(bad_date(c), 1).otherwise(0)).alias("invalid_count")) for c in columns]
    out = df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("e")).select("e.*")
    return out.withColumn("invalid_pct", rate(F.col("invalid_count"), F.col("filled"), 2))


def column_profile(df: DataFrame, numeric: list[str], dates: list[str]) -> DataFrame:
    """One row per column: gaps, distinct values, outliers, bad dates, status and advice."""
    out = column_counts(df)
    out = out.join(outliers(df, numeric).select("column", "outlier_count"), "column", "left") if numeric else out.withColumn("outlier_count", F.lit(None))
    out = out.join(invalid_dates(df, dates).select("column", "invalid_count"), "column", "left") if dates else out.withColumn("invalid_count", F.lit(None))
    nulls, rows, unique = F.col("null_count"), F.col("row_count"), F.col("unique_count")
    constant = unique + F.when(nulls > 0, 1).otherwise(0) <= 1
    null_pct = rate(nulls, rows, 2)
    bad = F.coalesce("invalid_count", F.lit(0))
    far = F.coalesce("outlier_count", F.lit(0))
    advice = (
        F.when(constant, "drop_constant")
        .when(null_pct > 60.0, "drop_mostly_null")
        .when((null_pct > 0.0) & F.col("column").isin(numeric), "impute_numeric")
        .when(null_pct > 0.0, "impute_mode")
        .when(bad > 0, "standardize_dates")
        .when(far > 0, "clip_outliers")
        .otherwise("none")
    )
    status = F.when(nulls == 0, "GOOD").when(null_pct < 10, "WARNING").otherwise("CRITICAL")
    return out.select(
        "column",
        nulls.alias("null_count"),
        null_pct.alias("null_pct"),
        unique.alias("unique_count"),
        rate(unique, rows, 2).alias("unique_pct"),
        rate(rows - nulls, rows, 2).alias("completeness_score"),
        far.cast("bigint").alias("outlier_count"),
        bad.cast("bigint").alias("invalid_date_count"),
        constant.alias("is_constant"),
        advice.alias("advice"),
        status.alias("status"),
    )


def _grade(score: Column, limits: list[tuple[float, str]], last: str) -> Column:
    out = F.when(score >= limits[0][0], limits[0][1])
    for limit, name in limits[1:]:
        out = out.when(score >= limit, name)
    return out.otherwise(last)


def quality_score(df: DataFrame, numeric: list[str], dates: list[str]) -> DataFrame:
    """The four pillars, the weighted score, both ratings and the issue totals in one row.

    Each measure is a one-row aggregate; they meet as scalars, never through a join of rows.
    """
    columns = column_counts(df)
    constant = F.col("unique_count") + F.when(F.col("null_count") > 0, 1).otherwise(0) <= 1
    cells = columns.agg(
        F.struct(F.sum("null_count").alias("missing"), F.sum("row_count").alias("cells"), F.sum(F.when(constant, 1).otherwise(0)).alias("constants")).alias("s")
    ).scalar()
    zero = F.struct(F.lit(0).cast("bigint").alias("outliers"))
    far = outliers(df, numeric).agg(F.struct(F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("outliers")).alias("s")).scalar() if numeric else zero
    values = df.agg(sum((F.count(c) for c in numeric), F.lit(0)).alias("v")).scalar()
    bad = invalid_dates(df, dates).agg(F.sum("invalid_count").alias("b")).scalar() if dates else F.lit(0)
    base = duplicates(df).withColumns({"_cells": cells, "_far": far}).select(
        "row_count",
        "duplicate_rows",
        F.col("_cells.missing").alias("missing_values"),
        F.col("_cells.cells").alias("cells"),
        F.col("_cells.constants").alias("constant_columns"),
        F.col("_far.outliers").alias("outlier_count"),
        values.alias("numeric_values"),
        bad.alias("invalid_dates"),
    )

    def pct(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.lit(1), F.col(b)).cast("double") * 100.0

    def floor0(x: Column) -> Column:
        return F.greatest(F.lit(0.0), x)

    missing, dup = pct("missing_values", "cells"), pct("duplicate_rows", "row_count")
    pillars = {
        "completeness": floor0(100.0 - missing),
        "uniqueness": floor0(100.0 - dup),
        "validity": floor0(100.0 - (missing * MISSING_PENALTY + pct("invalid_dates", "row_count") * DATE_PENALTY)),
        "consistency": floor0(100.0 - (pct("outlier_count", "numeric_values") * OUTLIER_PENALTY + F.col("constant_columns") * CONSTANT_PENALTY)),
    }
    score = F.round(F.least(F.lit(100.0), sum((pillars[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))), 2)
    issues = sum((F.col(c) for c in ("missing_values", "duplicate_rows", "invalid_dates", "outlier_count", "constant_columns")), F.lit(0))
    scored = base.withColumn("quality_score", score)
    return scored.select(
        "row_count",
        "quality_score",
        *[F.round(p, 2).alias(f"{k}_score") for k, p in pillars.items()],
        _grade(F.col("quality_score"), RATINGS, "POOR").alias("rating"),
        _grade(F.col("quality_score"), REPORT_RATINGS, "CRITICAL").alias("report_rating"),
        "missing_values",
        "duplicate_rows",
        "invalid_dates",
        "outlier_count",
        "constant_columns",
        issues.alias("total_issues"),
    )


def simple_score(df: DataFrame) -> DataFrame:
    """100 - 0.4 x missing percent - 0.6 x duplicate percent."""
    light = light_profile(df).agg(F.first("missing_cells")).scalar()
    width = len(df.columns)
    out = duplicates(df).withColumn("missing_cells", light)
    missing = F.col("missing_cells").cast("double") / F.greatest(F.lit(1), F.col("row_count") * width) * 100.0
    dup = F.col("duplicate_rows").cast("double") / F.greatest(F.lit(1), F.col("row_count")) * 100.0
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - (missing * 0.4 + dup * 0.6)))
    return out.select("row_count", "missing_cells", "duplicate_rows", F.round(score, 4).alias("quality_score"))


def _has_null(df: DataFrame) -> Column:
    return sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0)) > 0


def problem_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """First ``n`` rows with gaps or copies, in the stated order, with the reason.

    Equal rows are folded to one with a count, so no window gathers copies; a group is unfolded to
    at most ``n`` rows only after the head is taken.
    """
    width = df.columns
    folded = df.groupBy(*width).agg(F.count(F.lit(1)).alias("_n"))
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in width]))
    gaps = F.when(F.size(names) > 0, F.concat(F.lit("Missing values in: "), F.array_join(names, ", ")))
    copies = F.when(F.col("_n") > 1, F.lit("Duplicate row"))
    flagged = folded.withColumn("reason", F.concat_ws(" | ", gaps, copies)).filter(F.col("reason") != "")
    keys = [F.col(order), *[F.col(c) for c in width if c != order]]
    head = flagged.orderBy(*keys).limit(n)
    unfolded = head.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(n)).cast("int"))))
    return unfolded.orderBy(*keys, "copy").limit(n).drop("_n")


def issue_rows(df: DataFrame, kind: str, column: str | None = None) -> DataFrame:
    """All rows behind an issue, equal rows folded into one with ``occurrences``."""
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("occurrences"))
    if kind == "missing":
        return folded.filter(_has_null(df))
    if kind == "duplicates":
        return folded.filter(F.col("occurrences") > 1)
    if kind == "invalid_dates":
        return folded.filter(bad_date(column))
    if kind == "outliers":
        fence = outlier_bounds(df, [column]).agg(F.first(F.struct("lower", "upper")).alias("f")).scalar()
        marked = folded.withColumn("_fence", fence)
        return marked.filter((F.col(column) < F.col("_fence.lower")) | (F.col(column) > F.col("_fence.upper"))).drop("_fence")
    return folded.filter(_has_null(df) | (F.col("occurrences") > 1))


def source_profile(df: DataFrame) -> DataFrame:
    """Null-like tokens per column, plus row and duplicate counts of the source."""
    def null_like(c: str) -> Column:
        text = F.lower(F.trim(F.col(c).cast("string")))
        return F.sum(F.when(text.isNull() | text.isin(NULL_TOKENS), 1).otherwise(0))

    entries = [F.struct(F.lit(c).alias("column"), null_like(c).alias("null_count")) for c in df.columns]
    dup = duplicates(df).agg(F.first("duplicate_rows")).scalar()
    out = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*entries).alias("a")).select("row_count", F.explode("a").alias("e"))
    return out.select(
        "e.column", "row_count", "e.null_count", rate(F.col("e.null_count"), F.col("row_count"), 2).alias("null_pct"), dup.alias("duplicate_rows")
    )
