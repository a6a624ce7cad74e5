"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the smallest b of each a; a busy node is one combined row on the small side."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def roots(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a of an edge table that is not the smallest of its component b.

    edges: columns a and b, not NULL, any direction, loops and repeats allowed. Every round is written to
    the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _least(large)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        current = materialize(small.where("a <> b").distinct(), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    return current
