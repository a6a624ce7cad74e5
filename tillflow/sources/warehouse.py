"""Loading the star schema into a warehouse and counting what arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bronze import write_table

GOLD_TABLES = ["dim_date", "dim_location", "dim_customer", "dim_product", "dim_seller", "fact_sales"]


def jdbc_writer(url: str, properties: dict[str, str], schema: str = "gold", connections: int = 16) -> Callable[[str, DataFrame], None]:
    """Writer into ``schema.table`` of a JDBC database, replacing the rows but keeping the table."""
    def write(name: str, df: DataFrame) -> None:
        options = {"truncate": "true", "batchsize": "10000", "numPartitions": str(connections), **properties}
        df.write.format("jdbc").mode("overwrite").options(url=url, dbtable=f"{schema}.{name}", **options).save()

    return write


def parquet_writer(root: str) -> Callable[[str, DataFrame], None]:
    return lambda name, df: write_table(df, f"{root}/{name}")


def load_warehouse(tables: dict[str, DataFrame], write: Callable[[str, DataFrame], None]) -> None:
    for name, df in tables.items():
        write(name, df)


def row_counts(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Rows per loaded table; counts come from the Parquet footers."""
    out = None
    for name in names:
        row = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out
