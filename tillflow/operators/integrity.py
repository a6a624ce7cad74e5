"""Referential checks: child keys probed against parent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probe(child: DataFrame, parent: DataFrame, on: dict[str, str], flag: str, carry: list[str] | None = None) -> DataFrame:
    """Left join on distinct parent keys; ``flag`` tells whether the parent exists.

    Parent keys are made unique first, so a repeated parent can never multiply child rows. Columns
    in ``carry`` come along from the parent (they must depend on the key). With the child on the
    preserved side, adaptive execution can split a hot key of the child.
    """
    carry = carry or []
    renamed = parent.select(
        *[F.col(p).alias(f"_ref_{c}") for c, p in on.items()], *[F.col(c) for c in carry], F.lit(True).alias("_hit")
    )
    keys = [f"_ref_{c}" for c in on]
    if carry:
        unique = renamed.groupBy(*keys).agg(*[F.min(c).alias(c) for c in carry], F.first("_hit").alias("_hit"))
    else:
        unique = renamed.distinct()
    cond = [F.col(c) == F.col(f"_ref_{c}") for c in on]
    out = child.join(unique, cond, "left")
    return out.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit", *keys)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti")
