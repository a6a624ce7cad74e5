"""Hash trees over ordered leaves: digests that are built, compared and searched in parallel.

A leaf is one record; ``fanout`` neighbours are hashed into a node of the next level until one node of
each key is left, its root. A node without neighbours carries its digest up unchanged, so the root of a
key does not depend on how tall the trees of other keys are. Leaves and nodes are hashed under different
marks. Every level is a group-by on (key, node / fanout), so a single long key spreads over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .prefix import numbered, same

FANOUT = 256


def leaf(columns: list[str | Column]) -> Column:
    """Digest of a record: every field as text after its length, NULL as a dash, so fields cannot run together."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(F.lit("leaf:"), *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(level: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """The next level of (keys, node, digest)."""
    held = level.groupBy(*keys, F.floor(F.col("node") / fanout).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("_c"))
    own = F.concat(F.lit("node:"), F.array_join(F.transform("_c", lambda c: c["digest"]), ""))
    return held.select(*keys, "node", F.when(F.size("_c") == 1, F.col("_c")[0]["digest"]).otherwise(F.sha2(own, 256)).alias("digest"))


def tree(leaves: DataFrame, keys: list[str], fanout: int = FANOUT, height: int | None = None) -> list[DataFrame]:
    """Stored levels of (keys, node, digest), leaves first. Without ``height`` it grows to the roots."""
    levels = [materialize(leaves.select(*keys, "node", "digest"), "tree-level")]
    while len(levels) < height if height else (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(materialize(fold(levels[-1], keys, fanout), "tree-level"))
    return levels


def broken_leaves(stored: list[DataFrame], now: list[DataFrame], keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, node) of leaves that differ, are gone or came on, found from the roots down.

    A branch whose digests agree is not entered, so the joins below the roots only touch bad branches.
    """
    bad = None
    for old, new in zip(reversed(stored), reversed(now), strict=True):
        if bad is not None:
            parent = bad.withColumnRenamed("node", "_parent")
            old, new = [
                side.alias("p").join(parent.alias("b"), same("p", "b", keys) & (F.floor(F.col("p.node") / fanout) == F.col("b._parent")), "left_semi") for side in (old, new)
            ]
        pairs = old.alias("o").join(new.alias("n"), same("o", "n", [*keys, "node"]), "full")
        wrong = pairs.where(~F.col("o.digest").eqNullSafe(F.col("n.digest")))
        present = F.col("o.digest").isNotNull()
        bad = wrong.select(*[F.when(present, F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in [*keys, "node"]]).distinct()
    return bad


def seal_log(log: DataFrame, chain: list[str], bucket: str, order: list[str]) -> DataFrame:
    """``log`` with the position of every record in its chain, as the writer stores it.

    ``bucket`` is a column that rises with the order (a day, an hour) and bounds what one task numbers.
    """
    return numbered(log, chain, bucket, order)


def log_tree(sealed: DataFrame, chain: list[str], columns: list[str], fanout: int = FANOUT, height: int | None = None) -> list[DataFrame]:
    return tree(sealed.select(*chain, F.col("position").alias("node"), leaf(columns).alias("digest")), chain, fanout, height)


def verify_log(sealed: DataFrame, stored: list[DataFrame], chain: list[str], columns: list[str], fanout: int = FANOUT) -> DataFrame:
    """Per chain of the stored tree or of the log: records found, broken records, first broken position, stored root, validity."""
    now = log_tree(sealed, chain, columns, fanout, len(stored))
    broken = broken_leaves(stored, now, chain, fanout).groupBy(*chain).agg(F.count(F.lit(1)).alias("broken"), F.min("node").alias("first_broken"))
    found = now[0].groupBy(*chain).agg(F.count(F.lit(1)).alias("records"))
    parts = [
        stored[-1].where("node = 0").select(*chain, F.col("digest").alias("root"), F.lit(None).cast("long").alias("records"), F.lit(None).cast("long").alias("broken"), F.lit(None).cast("long").alias("first_broken")),
        found.select(*chain, F.lit(None).cast("string").alias("root"), "records", F.lit(None).cast("long").alias("broken"), F.lit(None).cast("long").alias("first_broken")),
        broken.select(*chain, F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("records"), "broken", "first_broken"),
    ]
    merged = reduce(DataFrame.unionByName, parts).groupBy(*chain)
    per_chain = merged.agg(F.max("root").alias("root"), F.coalesce(F.max("records"), F.lit(0)).alias("records"), F.coalesce(F.max("broken"), F.lit(0)).alias("broken"), F.max("first_broken").alias("first_broken"))
    return per_chain.withColumn("valid", F.col("broken") == 0)
