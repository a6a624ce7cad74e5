"""Filters, slicers, sampling and small selections used on any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.numbers import percent

UNSPECIFIED = "Unspecified"
OTHER = "Other"
BLANKS = ["", "nan", "None"]


def slicer(
    df: DataFrame,
    date_range: tuple[str, str, str] | None = None,
    values: dict[str, list] | None = None,
) -> DataFrame:
    """Conjunction of an inclusive date range (column, first day, last day) and value lists.

    The date range is stated on the raw column as a half-open interval, so it reaches the scan and
    prunes partitions and row groups. Unknown columns raise instead of being ignored.
    """
    wanted = [*(values or {}), *([date_range[0]] if date_range else [])]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"unknown slicer columns: {missing}")
    out = df
    if date_range:
        column, first, last = date_range
        kind = df.schema[column].dataType.simpleString()
        upper = F.date_add(F.lit(last).cast("date"), 1)
        out = out.filter((F.col(column) >= F.lit(first).cast(kind)) & (F.col(column) < upper.cast(kind)))
    for column, members in (values or {}).items():
        if members:
            out = out.filter(F.col(column).isin(list(members)))
    return out


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def text_search(df: DataFrame, needle: str) -> DataFrame:
    """Rows with the literal ``needle`` in any text column, ignoring case."""
    hits = [F.lower(c).contains(needle.lower()) for c in text_columns(df)]
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def sort_limit(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Sorted head of a table; Spark keeps only ``n`` rows per task (take-ordered)."""
    return df.orderBy(*order).limit(n)


def group_label(c: str) -> Column:
    """Group key as shown: NULL and blank text become ``Unspecified``."""
    text = F.trim(F.col(c).cast("string"))
    return F.when(text.isNull() | text.isin(BLANKS), UNSPECIFIED).otherwise(text)


def top_groups(df: DataFrame, group: str, value: Column, n: int) -> DataFrame:
    totals = df.groupBy(group_label(group).alias(group)).agg(F.sum(value).alias("total"))
    return totals.orderBy(F.col("total").desc(), F.col(group)).limit(n)


def top_and_other(df: DataFrame, group: str, value: Column | None, n: int) -> DataFrame:
    """The ``n`` largest groups by the sum of positive values, the rest folded into ``Other``.

    The head comes from a take-ordered of the grouped totals; the rest is the grand total minus the
    head, so no window over all groups is needed.
    """
    amount = value if value is not None else F.lit(1)
    kept = df.select(group_label(group).alias(group), amount.alias("_v")).filter(F.col("_v") > 0)
    totals = kept.groupBy(group).agg(F.sum("_v").alias("total"))
    head = totals.orderBy(F.col("total").desc(), F.col(group)).limit(n)
    head_sum = head.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("h")).scalar()
    rest = totals.agg(F.sum("total").alias("all")).select(
        F.lit(OTHER).alias(group), (F.col("all") - head_sum).alias("total")
    )
    return head.unionByName(rest.filter(F.col("total") > 0))


def segment_share(df: DataFrame, group: str, member: str, value: Column) -> DataFrame:
    """Sum, share of the total (denominator at least 1) and row count of one member."""
    inside = F.col(group).cast("string") == F.lit(member)
    out = df.agg(
        F.coalesce(F.sum(F.when(inside, value)), F.lit(0)).alias("segment_total"),
        F.coalesce(F.sum(value), F.lit(0)).alias("overall_total"),
        F.count(F.when(inside, 1)).alias("segment_rows"),
    )
    share = F.round(percent(F.col("segment_total"), F.greatest(F.lit(1.0), F.col("overall_total").cast("double"))), 6)
    return out.select(
        F.lit(member).alias("segment"),
        F.col("segment_total").cast("double").alias("segment_total"),
        F.col("overall_total").cast("double").alias("overall_total"),
        share.alias("share_pct"),
        "segment_rows",
    )


def hash_bucket(key: Column | str, buckets: int) -> Column:
    """Bucket of a key that every run and every executor computes alike."""
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def hash_sample(df: DataFrame, key: str, keep_one_in: int) -> DataFrame:
    """Repeatable sample of about 1/n of the keys, with the factor counts must be scaled by."""
    sampled = df.filter(hash_bucket(key, keep_one_in) == 0)
    return sampled.withColumn("scale_factor", F.lit(keep_one_in))


def correlation(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Number of complete pairs and their correlation, over all rows."""
    pairs = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).dropna()
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.corr("x", "y").alias("correlation"))


def scatter_sample(df: DataFrame, key: str, x: Column, y: Column, n: int) -> DataFrame:
    """The ``n`` pairs with the smallest key hash: bounded, repeatable, independent of file order."""
    pairs = df.select(F.col(key), x.cast("double").alias("x"), y.cast("double").alias("y")).dropna(subset=["x", "y"])
    return pairs.orderBy(F.sha2(F.col(key).cast("string"), 256), F.col(key)).limit(n)
