"""Running values over one long order, cut into buckets so that no key is bound to one task.

Rows of a key are ordered by (bucket, order). A window runs inside each bucket only; what earlier
buckets add comes from a table with one row per key and bucket. A key with a third of all rows thus
spreads over its buckets. The frame is read twice, so store it first where it is costly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def same(left: str, right: str, columns: list[str]) -> Column:
    """Equal in all columns, NULL being equal to NULL."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def sums_before(df: DataFrame, keys: list[str], bucket: str, order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """``df`` with one column per amount: its sum over all earlier rows of the key, 0 for the first."""
    for name, amount in amounts.items():
        df = df.withColumn(name, amount)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(n).alias(n) for n in amounts])
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, bucket, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in amounts])
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = df.select(*[c for c in df.columns if c not in amounts], *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in amounts])
    joined = placed.alias("p").join(starts.alias("s"), same("p", "s", [*keys, bucket]))
    plain = [F.col(f"p.{c}") for c in placed.columns if c not in amounts]
    return joined.select(*plain, *[(F.col(f"p.{n}") + F.col(f"s._{n}")).alias(n) for n in amounts])


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "position") -> DataFrame:
    """Position of every row in its key, from 0."""
    return sums_before(df, keys, bucket, order, {name: F.lit(1).cast("long")})


def switches_before(df: DataFrame, keys: list[str], bucket: str, order: list[str], off: Column, on: Column, name: str) -> DataFrame:
    """State (false at first) before every row, where a row leads from off to ``off`` and from on to ``on``.

    A row keeps the state, flips it, or sets it whatever it was. The state is the last value that was
    set, flipped once per flip since, so the rows of a bucket combine into one such step themselves.
    """
    df = df.withColumn("_flips", (off & ~on).cast("long")).withColumn("_set", F.when(off == on, off))
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    df = df.withColumn("_flips", F.sum("_flips").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    mark = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("to"), F.col("_flips").alias("at")))
    df = df.withColumn("_mark", F.last(mark, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = df.groupBy(*keys, bucket).agg(F.max("_flips").alias("_flips"), F.max_by("_mark", F.struct(*order)).alias("_mark"))
    path = W.partitionBy(*keys).orderBy(bucket)
    earlier = path.rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("_sum", F.sum("_flips").over(path.rowsBetween(W.unboundedPreceding, W.currentRow)))
    set_at = F.when(F.col("_mark").isNotNull(), F.struct(F.col("_mark.to").alias("to"), (F.col("_sum") - F.col("_flips") + F.col("_mark.at")).alias("at")))
    last = last.withColumn("_set_at", set_at)
    held = F.last("_set_at", ignorenulls=True).over(earlier)
    passed = F.coalesce(F.lag("_sum").over(path), F.lit(0))
    starts = last.select(*keys, bucket, _state(F.lit(False), held, passed).alias("_start"))
    joined = df.alias("p").join(starts.alias("s"), same("p", "s", [*keys, bucket]))
    joined = joined.select("p.*", "_start")
    before = F.coalesce(F.lag("_flips").over(inside), F.lit(0))
    state = _state(F.col("_start"), F.lag("_mark").over(inside), before)
    return joined.withColumn(name, state).drop("_flips", "_set", "_mark", "_start")


def _state(start: Column, mark: Column, flips: Column) -> Column:
    origin = F.coalesce(mark["to"], start)
    return origin != ((flips - F.coalesce(mark["at"], F.lit(0))) % 2 == 1)
