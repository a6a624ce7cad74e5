"""Hierarchies, drill-down and roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import quarter_label
from ..functions.numbers import percent_or_zero

# Name parts that mark the levels of a hierarchy, coarse to fine.
TIME_LEVELS = ["Year", "Quarter", "Month", "Day"]
GEO_LEVELS = ["region", "country", "state", "province", "city"]
PRODUCT_LEVELS = ["department", "category", "sub_category", "subcategory", "product", "item"]


def hierarchies(columns: list[str], date_column: str | None) -> dict[str, list[str]]:
    """Level columns of the time, geographic and product hierarchies a table supports."""
    out: dict[str, list[str]] = {}
    if date_column:
        out["Time Hierarchy"] = TIME_LEVELS
    for title, parts in [("Geographic Hierarchy", GEO_LEVELS), ("Product Hierarchy", PRODUCT_LEVELS)]:
        levels: list[str] = []
        for part in parts:
            levels += [c for c in columns if part in c.lower() and c not in levels]
        if len(levels) >= 2:
            out[title] = levels
    return out


def level_label(c: str, level: str) -> Column:
    return {
        "Year": F.date_format(c, "yyyy"),
        "Quarter": quarter_label(c),
        "Month": F.date_format(c, "yyyy-MM"),
        "Day": F.date_format(c, "yyyy-MM-dd"),
    }[level]


def drill_time(df: DataFrame, moment: str, value: str, level: str, parent: str | None = None) -> DataFrame:
    """Sum, count and mean per period of a level, optionally inside one period of the level above."""
    rows = df.filter(F.col(moment).isNotNull() & F.col(value).isNotNull())
    position = TIME_LEVELS.index(level)
    if parent is not None and position > 0:
        rows = rows.filter(level_label(moment, TIME_LEVELS[position - 1]) == parent)
    return rows.groupBy(level_label(moment, level).alias("period")).agg(
        F.sum(value).cast("double").alias("total"), F.count(value).alias("transactions"), F.avg(value).cast("double").alias("average")
    )


def rollup_time(df: DataFrame, moment: str, value: str) -> DataFrame:
    """All levels at once from one rollup: (Year), (Year, Quarter), (.., Month), (.., Day) and the total."""
    labelled = df.select(*[level_label(moment, lv).alias(lv.lower()) for lv in TIME_LEVELS], F.col(value).alias("_v"))
    # One row per day first: the rollup then expands days, not the input rows.
    days = labelled.groupBy(*[lv.lower() for lv in TIME_LEVELS]).agg(F.sum("_v").alias("s"), F.count("_v").alias("n"))
    out = days.rollup(*[lv.lower() for lv in TIME_LEVELS]).agg(
        F.sum("s").cast("double").alias("total"), F.sum("n").alias("transactions"), F.grouping_id().alias("g")
    )
    level = F.element_at(F.array(*[F.lit(x) for x in ("Total", "Year", "Quarter", "Month", "Day")]), 5 - F.log2(F.col("g") + 1).cast("int"))
    return out.select("year", "quarter", "month", "day", level.alias("level"), "total", "transactions")


def drill_dimension(df: DataFrame, parent: str, child: str, member: str, value: str) -> DataFrame:
    """Children of one parent member with their share of it."""
    inside = df.filter(F.col(parent).cast("string") == member)
    grouped = inside.filter(F.col(child).isNotNull()).groupBy(child).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("rows")
    )
    total = inside.agg(F.coalesce(F.sum(value), F.lit(0)).alias("t")).scalar()
    return grouped.select(child, F.col("s").cast("double").alias("total"), "rows", percent_or_zero(F.col("s"), total, 2).alias("share_pct"))


def rollup_dimension(df: DataFrame, parent: str, child: str, value: str) -> DataFrame:
    """Every parent with all its children, both subtotal levels and shares of the parent."""
    pairs = df.groupBy(parent, child).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    out = pairs.rollup(parent, child).agg(F.sum("s").alias("s"), F.sum("n").alias("rows"), F.grouping_id().alias("g"))
    # One row per (parent, child): a dimension, not the facts.
    whole = F.sum(F.when(F.col("g") == 0, F.col("s"))).over(W.partitionBy(parent, F.col("g") == 3))
    share = F.when(F.col("g") == 0, percent_or_zero(F.col("s"), whole)).when(F.col("g") == 1, F.lit(100.0))
    level = F.when(F.col("g") == 0, "child").when(F.col("g") == 1, "parent").otherwise("total")
    return out.select(parent, child, level.alias("level"), F.col("s").cast("double").alias("total"), "rows", F.round(share, 6).alias("share_pct"))
