"""Keep one row per business key, by a stated order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key under ``order``; give a total order for a repeatable result.

    The filter on ``row_number() = 1`` lets Spark limit every key to one row per map task before
    the shuffle, so a key holding a third of the table sends only a few rows to its reducer.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def keep_one_keyed(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """As ``keep_one``, but every row with a NULL or blank key part stays.

    Nothing says that such rows are copies of one another; rules reject and count them one by one. Each is a
    key of its own, by a number that no other row has, so the rows are read once and spread over all tasks.
    """
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "" for k in keys])
    numbered = df.withColumn("_own", F.when(blank, F.monotonically_increasing_id()))
    return keep_one(numbered, [*keys, "_own"], order).drop("_own")


def duplicate_groups(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once with their count, combined on the map side."""
    keys = keys or df.columns
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, and the row total."""
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )
