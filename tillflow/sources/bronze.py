"""Landing raw tables: audit columns, idempotent writes, reconciliation and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import InputError


def audit_columns(df: DataFrame, system: str, version: str, ingested_at: str, source_file: Column | None = None) -> DataFrame:
    """Five columns that say when, from where and under which contract a row arrived."""
    return df.withColumns(
        {
            "_ingested_at": F.lit(ingested_at).cast("timestamp"),
            "_source_file": source_file if source_file is not None else F.col("_metadata.file_name"),
            "_source_system": F.lit(system),
            "_schema_version": F.lit(version),
            "ingestion_year_month": F.lit(ingested_at[:7]),
        }
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, only_brought: bool = False) -> None:
    """Idempotent overwrite of a whole table, so that a rerun with fewer partitions leaves none behind.

    With ``only_brought`` a partitioned table keeps the partitions that the rows do not name.
    Rows are rebalanced by the partition columns first: adaptive execution splits a large partition
    over several tasks and packs small ones, so the number of files follows the data and not
    tasks times partitions.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic" if only_brought else "static").partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, root: str, entity: str) -> DataFrame:
    path = f"{root}/{entity}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise InputError(f"table not found: {path}")
    return spark.read.parquet(path)


def write_with_variance(df: DataFrame, path: str, entity: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table and compare rows written with rows read back.

    The source is counted by an observation while it is written, so it is evaluated once.
    """
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, partition_by)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("written_rows")).select(
        F.lit(entity).alias("entity"),
        F.lit(seen.get["rows"]).cast("bigint").alias("source_rows"),
        "written_rows",
        (F.col("written_rows") - F.lit(seen.get["rows"])).alias("variance"),
    )


def manifest(tables: dict[str, DataFrame], partitions: dict[str, str]) -> DataFrame:
    """Rows, columns and partitioning per entity with a total row from the same rollup."""
    parts = None
    for entity, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(entity).alias("entity"), "row_count", F.lit(len(df.columns)).alias("columns"), F.lit(partitions.get(entity)).cast("string").alias("partitioned_by")
        )
        parts = row if parts is None else parts.unionByName(row)
    out = parts.rollup("entity").agg(
        F.sum("row_count").alias("row_count"), F.sum("columns").alias("columns"), F.max("partitioned_by").alias("p"), F.grouping("entity").alias("g")
    )
    total = F.col("g") == 1
    return out.select(
        F.when(total, "TOTAL").otherwise(F.col("entity")).alias("entity"), "row_count", "columns", F.when(~total, F.col("p")).alias("partitioned_by")
    )


def quarantine_folder(path: str, batch_id: str, rejected_at: str) -> str:
    return f"{path}/_rejection_date={rejected_at[:10]}/_processing_batch_id={batch_id}"


def write_quarantine(rejected: DataFrame, path: str, batch_id: str, rejected_at: str) -> None:
    """One folder per rejection date and batch: replaying a batch replaces its own rows, also by none."""
    write_table(rejected.drop("_rejection_date", "_processing_batch_id"), quarantine_folder(path, batch_id, rejected_at))


def append_history(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


HISTORY_SCHEMA = "run_id string, pipeline string, status string, started_at string, duration_seconds double, row_count bigint, metadata map<string,string>"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).json(path)
