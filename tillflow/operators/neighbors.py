"""Previous and next value per key without gathering a hot key in one task.

``lag`` over a key sorts all rows of that key in one task. Here the key is split by a coarse bucket
of its order column: inside a (key, bucket) the plain window works, and the first row of a bucket
takes over the edge value of the nearest bucket before it. Edge values are aggregated on the map
side (one row per key and bucket), so the only per-key window runs over buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_neighbor(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    values: dict[str, str],
    following: bool = False,
) -> DataFrame:
    """Add ``{alias: column}`` of the previous (or following) row under ``order`` within ``keys``.

    ``bucket`` must not decrease with ``order``; ``order`` must be total within a key.
    """
    direction = (lambda c: F.col(c).desc()) if following else (lambda c: F.col(c).asc())
    work = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*keys, "_bucket").orderBy(*[direction(c) for c in order])
    payload = F.struct(*[F.col(c).alias(a) for a, c in values.items()])
    work = work.withColumn("_prev", F.lag(payload).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)

    sort_key = F.struct(*order)
    edge = F.min_by(payload, sort_key) if following else F.max_by(payload, sort_key)
    edges = work.groupBy(*keys, "_bucket").agg(edge.alias("_edge"))
    outer = W.partitionBy(*keys).orderBy(F.col("_bucket").desc() if following else F.col("_bucket").asc())
    edges = edges.withColumn("_carry", F.lag("_edge").over(outer)).drop("_edge")
    renamed = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "_carry")
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    joined = work.join(renamed, cond, "left")
    chosen = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    out = joined.withColumn("_n", chosen)
    return out.select(*df.columns, *[F.col(f"_n.{a}").alias(a) for a in values])
