"""Incremental loads, upserts, backfills and dataset snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .bronze import write_table


def above_mark(source: DataFrame, column: str, mark: Column) -> DataFrame:
    """Rows processed after the high-water mark; everything when there is no mark yet."""
    return source.filter(mark.isNull() | (F.col(column) > mark))


def high_water_mark(target: DataFrame, column: str) -> Column:
    return target.agg(F.max(column).alias("m")).scalar()


def next_mark(batch: DataFrame, column: str, pipeline: str, old: Column) -> DataFrame:
    """Mark row after a batch; an empty batch keeps the old mark."""
    return batch.agg(F.coalesce(F.max(column), old).alias("high_water_mark"), F.count(F.lit(1)).alias("rows")).select(
        F.lit(pipeline).alias("pipeline"), "high_water_mark", "rows"
    )


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert new keys and replace existing ones by their newest version.

    Both sides are folded per key with map-side combine. Running the same changes again changes
    nothing. Equal versions prefer the change.
    """
    columns = [c for c in base.columns if c not in keys]
    tagged = base.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    newest = F.max_by(F.struct(*columns), F.struct(F.col(version), F.col("_side")))
    return tagged.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*").select(*base.columns)


def backfill(recomputed: DataFrame, path: str, partition: str, first, last) -> None:
    """Replace the partitions of a range, also those that now have no rows; partitions outside stay untouched.

    The rows are stored first, so they may come from the table itself. What is collected are partition values.
    """
    spark, inside = recomputed.sparkSession, F.col(partition).between(first, last)
    staged = materialize(recomputed.filter(inside), "backfill")
    write_table(staged, path, [partition], only_brought=True)

    def values(df: DataFrame) -> set:
        return {r[0] for r in df.select(partition).distinct().collect()}

    for value in values(spark.read.schema(staged.schema).parquet(path).filter(inside)) - values(staged):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={value}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def save_version(df: DataFrame, root: str, dataset: str, version: int, recipe: list[dict]) -> None:
    """Write a snapshot under its version, with the recipe that led to it. Version 0 is the original."""
    write_table(df, f"{root}/{dataset}/data/version={version}")
    spark = df.sparkSession
    row = spark.range(1).select(F.lit(json.dumps(recipe)).alias("recipe"), F.lit(len(recipe)).alias("steps"))
    row.write.mode("overwrite").json(f"{root}/{dataset}/recipe/version={version}")


def load_version(spark: SparkSession, root: str, dataset: str, version: int | None = None) -> DataFrame:
    """A stated version or the newest one."""
    every = spark.read.option("basePath", f"{root}/{dataset}/data").parquet(f"{root}/{dataset}/data")
    wanted = F.lit(version) if version is not None else every.agg(F.max("version")).scalar()
    return every.filter(F.col("version") == wanted)


def load_recipes(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    return spark.read.schema("recipe string, steps int, version int").json(f"{root}/{dataset}/recipe")
