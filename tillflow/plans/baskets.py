"""Order composition, price structure, lanes and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import mean_money, percent, ratio
from ..operators.ranking import column_quantiles


def price_histogram(items: DataFrame, column: str, buckets: int) -> DataFrame:
    """Equal-width histogram with exact quartiles; range and quartiles enter as scalars."""
    price = F.col(column).cast("double")
    bounds = items.agg(F.struct(F.min(price).alias("lo"), F.max(price).alias("hi")).alias("b")).scalar()
    quart = column_quantiles(items.select(price.alias("price")), ["price"], [0.25, 0.5, 0.75]).select("q").scalar()
    placed = items.withColumn("_b", bounds)
    # One constant price has no width: all its rows are in the first bucket.
    share = F.coalesce(F.try_divide((price - F.col("_b.lo")) * buckets, F.col("_b.hi") - F.col("_b.lo")), F.lit(0.0))
    place = F.when(price.isNotNull(), F.least(F.floor(share) + 1, F.lit(buckets)))
    hist = placed.groupBy(place.alias("bucket")).agg(
        F.count(F.lit(1)).alias("items"), F.sum(column).cast("double").alias("revenue")
    )
    return hist.withColumn("_q", quart).select(
        "bucket", "items", "revenue", *[F.round(F.col("_q")[i], 6).alias(a) for i, a in enumerate(("p25", "median", "p75"))]
    )


def basket_sizes(order_revenue: DataFrame) -> DataFrame:
    return order_revenue.groupBy("total_items_count").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("gross_order_revenue").cast("double").alias("revenue")
    )


def basket_pairs(items: DataFrame, products: DataFrame, group: str) -> DataFrame:
    """In how many orders two categories meet.

    Orders are reduced to their set of categories and equal sets are counted, both map-side
    combined. Pairs are read off the distinct sets, whose number depends on the categories and not
    on the orders or on the size of any one basket.
    """
    sets = (
        items.join(products.select("product_id", group), "product_id")
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_set(group)).alias("s"))
        .groupBy("s")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = sets.select("n", F.posexplode("s").alias("i", "left"), "s")
    pairs = first.select("n", "left", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("right"))
    return pairs.groupBy(F.col("left").alias("category_a"), F.col("right").alias("category_b")).agg(F.sum("n").alias("orders_together"))


def sku_ranking(items: DataFrame, products: DataFrame, n: int) -> DataFrame:
    """The ``n`` best products per category. The rank filter is applied per task before the shuffle
    by category, so a category with most of the products does not flood one reducer."""
    totals = items.groupBy("product_id").agg(
        F.sum("total_item_value").alias("revenue"), F.sum("order_item_quantity").alias("units")
    )
    named = totals.join(products.select("product_id", "category"), "product_id")
    order = W.partitionBy("category").orderBy(F.col("revenue").desc(), F.col("product_id"))
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.withColumn("revenue", F.col("revenue").cast("double"))


def with_delivery(items: DataFrame, headers: DataFrame) -> DataFrame:
    joined = items.join(headers.select("order_id", "customer_id", "purchased_at", "estimated_at"), "order_id")
    return joined.withColumns(
        {
            "delivery_days": F.datediff("delivered_at", "purchased_at"),
            "is_delayed": F.when(F.col("delivered_at") > F.col("estimated_at"), 1).otherwise(0),
        }
    )


def freight_by_state(items: DataFrame, headers: DataFrame, customers: DataFrame) -> DataFrame:
    per_customer = (
        with_delivery(items, headers)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("freight_value").alias("f"),
            F.sum("total_item_value").alias("g"),
            F.sum("is_delayed").alias("d"),
        )
    )
    return (
        per_customer.join(customers.select("customer_id", "state"), "customer_id")
        .groupBy("state")
        .agg(
            mean_money(F.sum("f"), F.sum("n")).alias("average_freight"),
            F.round(percent(F.sum("f"), F.sum("g")), 6).alias("freight_share_pct"),
            F.round(percent(F.sum("d"), F.sum("n")), 6).alias("delayed_pct"),
        )
    )


def lane_latency(items: DataFrame, headers: DataFrame, customers: DataFrame, sellers: DataFrame) -> DataFrame:
    """Delivery days from seller state to customer state.

    Rows are counted per (lane, days) first; days are whole numbers, so the exact percentile with
    frequencies works on a handful of values per lane.
    """
    lines = with_delivery(items, headers)
    lines = lines.join(customers.select("customer_id", F.col("state").alias("to_state")), "customer_id")
    lines = lines.join(sellers.select("seller_id", F.col("seller_state").alias("from_state")), "seller_id")
    counted = lines.groupBy("from_state", "to_state", "delivery_days").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_delayed").alias("late")
    )
    days = F.col("delivery_days")
    return counted.groupBy("from_state", "to_state").agg(
        F.sum("n").alias("items"),
        ratio(F.sum(days * F.col("n")), F.sum("n"), 6).alias("average_days"),
        F.percentile(days, 0.5, F.col("n")).alias("median_days"),
        F.percentile(days, 0.9, F.col("n")).alias("p90_days"),
        F.round(percent(F.sum("late"), F.sum("n")), 6).alias("delayed_pct"),
    )


def throughput(events: DataFrame, width: str) -> DataFrame:
    return (
        events.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events")
    )


def alert_rows(frame: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """Rows (severity, alert, value) for the checks of a one-row frame that hold."""
    rows = [
        F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("alert"), value.cast("double").alias("value")))
        for sev, name, value, cond in checks
    ]
    return frame.select(F.explode(F.array_compact(F.array(*rows))).alias("a")).select("a.*")
