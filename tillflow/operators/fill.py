"""Forward and backward fill by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_directional(
    df: DataFrame, keys: list[str], order: list[str], column: str, bucket: Column, backward: bool = False
) -> DataFrame:
    """Replace NULL by the nearest known value before (or after) it within the key.

    A key is cut into buckets of its order column. Inside a bucket a window fills; across buckets the
    nearest known value is carried over from per-bucket aggregates, so a hot key is spread over as
    many tasks as it has buckets.
    """
    work = df.withColumn("_bucket", bucket)
    directions = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    inner = W.partitionBy(*keys, "_bucket").orderBy(*directions).rowsBetween(W.unboundedPreceding, W.currentRow)
    work = work.withColumn("_local", F.last(column, ignorenulls=True).over(inner))

    known = F.when(F.col(column).isNotNull(), F.struct(*order))
    pick = F.min_by(column, known) if backward else F.max_by(column, known)
    edges = work.groupBy(*keys, "_bucket").agg(pick.alias("_edge"))
    outer = W.partitionBy(*keys).orderBy(F.col("_bucket").desc() if backward else F.col("_bucket").asc())
    edges = edges.withColumn("_carry", F.last("_edge", ignorenulls=True).over(outer.rowsBetween(W.unboundedPreceding, -1)))
    renamed = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "_carry")
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    filled = work.join(renamed, cond, "left").withColumn(column, F.coalesce("_local", "_carry"))
    return filled.select(*df.columns)
