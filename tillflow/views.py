"""The given tables seen as a retail shop: orders, order items, customers, products, sellers.

Every view is a lazy projection, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import date_key, year_month
from .functions.numbers import money

ESTIMATED_DAYS = 30


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freight() -> Column:
    """Freight of an item: price times tax rate, exact to cents."""
    return (F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(12,2)")


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchased = F.col("o_orderdate").cast("timestamp")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("order_priority"),
        money("o_totalprice").alias("order_amount"),
        purchased.alias("purchased_at"),
        F.date_add(purchased.cast("date"), ESTIMATED_DAYS).cast("timestamp").alias("estimated_at"),
        year_month(purchased).alias("order_year_month"),
        date_key(purchased).alias("order_date_key"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = money("l_extendedprice")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.lit(1).alias("order_item_quantity"),
        F.col("l_quantity").alias("quantity"),
        price.alias("item_price"),
        freight().alias("freight_value"),
        (price + freight()).cast("decimal(12,2)").alias("total_item_value"),
        F.col("l_discount").alias("discount"),
        F.col("l_shipdate").cast("timestamp").alias("delivered_at"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with state (nation) and region. Nations and regions are tiny, Spark broadcasts
    them by their file size; customers grow with the data and are never forced into a broadcast."""
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    customer = load(spark, sf_dir, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_unique_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("region"),
        money("c_acctbal").alias("balance"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_size").alias("size"),
        money("p_retailprice").alias("list_price"),
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    supplier = load(spark, sf_dir, "supplier")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_name").alias("seller_name"),
        F.col("n_name").alias("seller_state"),
        money("s_acctbal").alias("seller_balance"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with a zoned timestamp, as watermarks need it."""
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def retail_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items with everything known about them: the frame an analyst would upload."""
    items = order_items(spark, sf_dir)
    headers = order_headers(spark, sf_dir).select("order_id", "customer_id", "order_status", "purchased_at")
    people = customers(spark, sf_dir).select("customer_id", "region")
    goods = products(spark, sf_dir).select("product_id", "product_name", "category")
    joined = items.join(headers, "order_id").join(people, "customer_id").join(goods, "product_id")
    return joined.select(
        "order_id",
        F.col("purchased_at").alias("order_date"),
        "customer_id",
        "product_name",
        "category",
        "region",
        "quantity",
        F.col("total_item_value").alias("revenue"),
        (F.col("item_price") - F.col("freight_value")).alias("profit"),
        F.col("order_status").alias("status"),
    )
