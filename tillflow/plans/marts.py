"""Sales marts.

Items are rolled up to one row per order before anything else is joined. The roll-up is combined
on the map side, so an order holding a large part of all items costs no more than any other, and
after it ``count(distinct order_id)`` is a plain count on the order grain: no expand, no second
shuffle of the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mean_money, ratio


def order_revenue(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count("order_item_id").alias("total_items_count"),
        F.sum("order_item_quantity").alias("total_quantity"),
        F.sum("item_price").alias("product_revenue"),
        F.sum("freight_value").alias("freight_revenue"),
        F.sum("total_item_value").alias("gross_order_revenue"),
    )


def orders_with_revenue(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Inner join on the order key; both sides are shuffled on it once."""
    return order_revenue(items).join(headers, "order_id")


def _totals(prefix: str = "") -> list[Column]:
    return [
        F.count(F.lit(1)).alias(f"{prefix}orders"),
        F.sum("total_quantity").alias(f"{prefix}units_sold"),
        F.sum("product_revenue").alias(f"{prefix}product_revenue"),
        F.sum("freight_revenue").alias(f"{prefix}freight_revenue"),
        F.sum("gross_order_revenue").alias(f"{prefix}gross_revenue"),
    ]


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    """Exact decimal sums leave the engine as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def sales_summary(items: DataFrame) -> DataFrame:
    out = order_revenue(items).agg(*_totals("total_"))
    out = out.withColumn("average_order_value", mean_money(F.col("total_gross_revenue"), F.col("total_orders")))
    return as_double(out, "total_product_revenue", "total_freight_revenue", "total_gross_revenue")


def daily_sales(items: DataFrame, headers: DataFrame) -> DataFrame:
    out = orders_with_revenue(items, headers).groupBy("order_date_key", "order_year_month").agg(*_totals("daily_"))
    out = out.withColumn("daily_aov", mean_money(F.col("daily_gross_revenue"), F.col("daily_orders")))
    return as_double(out, "daily_product_revenue", "daily_freight_revenue", "daily_gross_revenue")


def monthly_trend(items: DataFrame, headers: DataFrame) -> DataFrame:
    out = orders_with_revenue(items, headers).groupBy("order_year_month").agg(
        F.sum("gross_order_revenue").alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("total_quantity").alias("units"),
    )
    return as_double(out, "revenue")


def regional_sales(items: DataFrame, headers: DataFrame, customers: DataFrame) -> DataFrame:
    per_customer = (
        orders_with_revenue(items, headers)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("total_quantity").alias("q"),
            F.sum("gross_order_revenue").alias("g"),
        )
    )
    out = (
        per_customer.join(customers.select("customer_id", "state"), "customer_id")
        .groupBy("state")
        .agg(
            F.sum("n").alias("total_orders"),
            F.sum("q").alias("units_sold"),
            F.sum("g").alias("regional_gross_revenue"),
        )
    )
    return as_double(out, "regional_gross_revenue")


def product_performance(items: DataFrame, products: DataFrame) -> DataFrame:
    """Two steps: one row per (category, order), then per category; the first is map-side combined."""
    per_order = (
        items.join(products.select("product_id", "category"), "product_id")
        .groupBy("category", "order_id")
        .agg(F.sum("order_item_quantity").alias("q"), F.sum("total_item_value").alias("g"))
    )
    out = per_order.groupBy(F.col("category").alias("category_name")).agg(
        F.count(F.lit(1)).alias("orders_count"),
        F.sum("q").alias("units_sold"),
        F.sum("g").alias("category_revenue"),
    )
    return as_double(out, "category_revenue")


def customer_value(items: DataFrame, headers: DataFrame, customers: DataFrame) -> DataFrame:
    per_customer = (
        orders_with_revenue(items, headers)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("gross_order_revenue").alias("g"),
            F.min("order_year_month").alias("first"),
            F.max("order_year_month").alias("last"),
        )
    )
    out = (
        per_customer.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.sum("n").alias("lifetime_orders_count"),
            F.sum("g").alias("observed_clv"),
            F.min("first").alias("first_order_month"),
            F.max("last").alias("latest_order_month"),
        )
    )
    return as_double(out, "observed_clv")


def executive_kpis(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Totals per customer first, so that distinct customers are a plain count."""
    per_customer = (
        orders_with_revenue(items, headers)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("total_quantity").alias("q"),
            F.sum("freight_revenue").alias("f"),
            F.sum("gross_order_revenue").alias("g"),
        )
    )
    out = per_customer.agg(
        F.sum("g").alias("total_gross_revenue"),
        F.sum("n").alias("total_orders"),
        F.sum("q").alias("units_sold"),
        mean_money(F.sum("g"), F.sum("n")).alias("average_order_value"),
        mean_money(F.sum("f"), F.sum("q")).alias("average_freight_per_item"),
        F.count("customer_id").alias("customers"),
    )
    return as_double(out, "total_gross_revenue")


def customer_measures(items: DataFrame, headers: DataFrame) -> DataFrame:
    per_customer = (
        orders_with_revenue(items, headers)
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("gross_order_revenue").alias("g"))
    )
    repeat = F.sum(F.when(F.col("n") > 1, 1).otherwise(0))
    return per_customer.agg(
        F.count(F.lit(1)).alias("unique_customers"),
        mean_money(F.sum("g"), F.count(F.lit(1))).alias("revenue_per_customer"),
        ratio(repeat * 100, F.count(F.lit(1)), 6).alias("repeat_rate_pct"),
    )


def grain_violations(items: DataFrame) -> DataFrame:
    return (
        items.groupBy("order_id", "order_item_id")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )
