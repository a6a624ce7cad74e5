"""Typed, deduplicated, rule-checked entities.

Each function takes raw (all-text) frames and returns the *flagged* frame: clean columns plus the
failed rules. ``rules.valid`` and ``rules.quarantine`` split it. Bad text becomes NULL through
``try_cast`` and is then caught by a rule, so no row can fail the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_timestamp, year_month
from ..functions.numbers import money
from ..functions.text import required
from ..operators.dedup import keep_one_keyed
from ..operators.integrity import probe
from ..operators.rules import Rule, flag, valid
from ..raw import STATES

# Order states a valid order may be in.
ORDER_STATUSES = ["approved", "canceled", "created", "delivered", "invoiced", "processing", "shipped", "unavailable"]

# Earliest purchase and coordinate bounds.
FIRST_PURCHASE = "2016-01-01"
LATITUDE = (-35.0, 6.0)
LONGITUDE = (-75.0, -30.0)
UNCLASSIFIED = "unclassified"

DIMENSION = "decimal(10,2)"
VOLUME = "decimal(12,2)"


def _trim(*cols: str) -> dict[str, Column]:
    return {c: F.trim(c) for c in cols}


def _parsed(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Timestamps from the text columns that the source has."""
    return {c: parse_timestamp(c) for c in columns if c in df.columns}


def _total_order(df: DataFrame, first: list[str] | None = None) -> list[Column]:
    """Order by the stated columns that exist, then by all others: equal rows are the only ties left."""
    first = [c for c in first or [] if c in df.columns]
    return [F.col(c).asc_nulls_last() for c in [*first, *[c for c in df.columns if c not in first]]]


def categories(raw: DataFrame) -> DataFrame:
    clean = raw.withColumns(_trim("product_category_name", "product_category_name_english"))
    unique = keep_one_keyed(clean, ["product_category_name"], _total_order(clean))
    return flag(
        unique,
        [
            Rule("DQ001", "Category name required", required("product_category_name")),
            Rule("DQ002", "English category name required", required("product_category_name_english")),
        ],
    )


def customers(raw: DataFrame) -> DataFrame:
    clean = raw.withColumns(_trim("customer_id", "customer_unique_id", "customer_zip_code_prefix")).withColumns(
        {"customer_city": F.initcap(F.trim("customer_city")), "customer_state": F.upper(F.trim("customer_state"))}
    )
    unique = keep_one_keyed(clean, ["customer_id"], _total_order(clean))
    return flag(
        unique,
        [
            Rule("DQ002", "Customer id required", required("customer_id")),
            Rule("DQ002", "Customer unique id required", required("customer_unique_id")),
            Rule("DQ011", "State code known", F.col("customer_state").isin(STATES)),
        ],
    )


def sellers(raw: DataFrame) -> DataFrame:
    clean = raw.withColumns(_trim("seller_id", "seller_zip_code_prefix")).withColumns(
        {"seller_city": F.initcap(F.trim("seller_city")), "seller_state": F.upper(F.trim("seller_state"))}
    )
    unique = keep_one_keyed(clean, ["seller_id"], _total_order(clean))
    return flag(
        unique,
        [
            Rule("DQ001", "Seller id required", required("seller_id")),
            Rule("DQ011", "State code known", F.col("seller_state").isin(STATES)),
        ],
    )


def volume(length: Column, height: Column, width: Column) -> Column:
    """Length x height x width; NULL when a part is missing, since NULL propagates."""
    return (length * height * width).cast(VOLUME)


def products(raw: DataFrame, valid_categories: DataFrame) -> DataFrame:
    clean = raw.select(
        F.trim("product_id").alias("product_id"),
        F.trim("product_category_name").alias("product_category_name_pt"),
        F.col("product_name_lenght").try_cast("int").alias("product_name_length"),
        F.col("product_description_lenght").try_cast("int").alias("product_description_length"),
        F.col("product_photos_qty").try_cast("int").alias("product_photos_qty"),
        *[F.col(c).try_cast(DIMENSION).alias(c) for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")],
    )
    clean = clean.withColumn(
        "product_volume_cm3",
        volume(F.col("product_length_cm"), F.col("product_height_cm"), F.col("product_width_cm")),
    )
    unique = keep_one_keyed(clean, ["product_id"], _total_order(clean))
    lookup = valid_categories.select(
        F.col("product_category_name").alias("product_category_name_pt"), "product_category_name_english"
    )
    named = unique.join(lookup, "product_category_name_pt", "left").withColumn(
        "product_category_name",
        F.coalesce("product_category_name_english", "product_category_name_pt", F.lit(UNCLASSIFIED)),
    )
    weight = F.col("product_weight_g")
    return flag(
        named,
        [
            Rule("DQ003", "Product id required", required("product_id")),
            Rule("DQ004", "Weight not negative", weight.isNull() | (weight >= 0)),
        ],
    )


def geolocation(raw: DataFrame) -> DataFrame:
    clean = raw.withColumns(
        {
            "geolocation_zip_code_prefix": F.trim("geolocation_zip_code_prefix"),
            "geolocation_lat": F.col("geolocation_lat").try_cast("double"),
            "geolocation_lng": F.col("geolocation_lng").try_cast("double"),
            "geolocation_city": F.initcap(F.trim("geolocation_city")),
            "geolocation_state": F.upper(F.trim("geolocation_state")),
        }
    )
    return flag(
        clean,
        [
            Rule("DQ011", "State code known", F.col("geolocation_state").isin(STATES)),
            Rule("DQ004", "Latitude in bounds", F.col("geolocation_lat").between(*LATITUDE)),
            Rule("DQ004", "Longitude in bounds", F.col("geolocation_lng").between(*LONGITUDE)),
        ],
    )


def centroids(valid_points: DataFrame) -> DataFrame:
    """One row per (zip, state): mean coordinates, sample count and the most frequent city.

    Points are first counted per city on the map side; the city is then the maximum of
    (count, name in reverse order), ties going to the alphabetically first name.
    """
    place = ["geolocation_zip_code_prefix", "geolocation_state"]
    per_city = valid_points.groupBy(*place, "geolocation_city").agg(
        F.count(F.lit(1)).alias("n"), F.sum("geolocation_lat").alias("lat"), F.sum("geolocation_lng").alias("lng")
    )
    return per_city.groupBy(*place).agg(
        F.min_by("geolocation_city", F.struct(-F.col("n"), F.col("geolocation_city"))).alias("geolocation_city"),
        F.round(F.sum("lat") / F.sum("n"), 6).alias("latitude"),
        F.round(F.sum("lng") / F.sum("n"), 6).alias("longitude"),
        F.sum("n").alias("_coordinate_samples_count"),
    )


def delivery_fields(purchased: Column, delivered: Column, estimated: Column) -> dict[str, Column]:
    return {
        "order_year_month": year_month(purchased),
        "delivery_days": F.datediff(delivered, purchased),
        "is_delayed": F.when(delivered > estimated, F.lit(True)).when(delivered.isNotNull(), F.lit(False)),
    }


def orders(raw: DataFrame, valid_customers: DataFrame) -> DataFrame:
    times = ["order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"]
    others = ["order_approved_at", "order_delivered_carrier_date"]
    clean = raw.withColumns(_trim("order_id", "customer_id")).withColumns(
        {"order_status": F.lower(F.trim("order_status")), **_parsed(raw, [*times, *others])}
    )
    # A line number, where the source has one, says which copy came first.
    unique = keep_one_keyed(clean, ["order_id"], _total_order(clean, ["_line"])).drop("_line")
    checked = probe(unique, valid_customers, {"customer_id": "customer_id"}, "_customer_exists")
    # These follow from the times: they decide no tie and are added behind the shuffles.
    checked = checked.withColumns(delivery_fields(*[F.col(c) for c in times]))
    bought, delivered = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    return flag(
        checked,
        [
            Rule("DQ001", "Order id required", required("order_id")),
            Rule("DQ002", "Customer id required", required("customer_id")),
            Rule("DQ007", "Order status known", F.col("order_status").isin(ORDER_STATUSES)),
            Rule("DQ008", "Purchase time valid", bought >= F.lit(FIRST_PURCHASE).cast("timestamp")),
            Rule("DQ009", "Delivered after purchase", delivered.isNull() | (delivered >= bought)),
            Rule("DQ010", "Customer exists", F.col("_customer_exists")),
        ],
    ).drop("_customer_exists")


def order_items(raw: DataFrame, valid_orders: DataFrame, valid_products: DataFrame, valid_sellers: DataFrame) -> DataFrame:
    price, cost = money(F.col("price")), money(F.col("freight_value"))
    clean = raw.withColumns(
        {
            **_trim("order_id", "product_id", "seller_id"),
            "order_item_id": F.col("order_item_id").try_cast("int"),
            **_parsed(raw, ["shipping_limit_date"]),
            "price": price,
            "freight_value": cost,
        }
    )
    unique = keep_one_keyed(clean, ["order_id", "order_item_id"], _total_order(clean))
    # The amount follows from the two others: it decides no tie and is added behind the shuffle.
    unique = unique.withColumn("total_item_amount", (F.col("price") + F.col("freight_value")).cast("decimal(12,2)"))
    checked = probe(unique, valid_orders, {"order_id": "order_id"}, "_order", carry=["order_year_month"])
    checked = probe(checked, valid_products, {"product_id": "product_id"}, "_product")
    checked = probe(checked, valid_sellers, {"seller_id": "seller_id"}, "_seller")
    return flag(
        checked,
        [
            Rule("DQ001", "Order id required", F.col("order_id").isNotNull()),
            Rule("DQ003", "Product id required", F.col("product_id").isNotNull()),
            Rule("DQ004", "Price not negative", F.col("price") >= 0),
            Rule("DQ005", "Freight not negative", F.col("freight_value") >= 0),
            Rule("DQ006", "Item number from 1", F.col("order_item_id") >= 1),
            Rule("DQ010", "Order exists", F.col("_order")),
            Rule("DQ010", "Product exists", F.col("_product")),
            Rule("DQ010", "Seller exists", F.col("_seller")),
        ],
    ).drop("_order", "_product", "_seller")


def payments(raw: DataFrame, valid_orders: DataFrame) -> DataFrame:
    clean = raw.withColumns(
        {
            "order_id": F.trim("order_id"),
            "payment_sequential": F.col("payment_sequential").try_cast("int"),
            "payment_type": F.lower(F.trim("payment_type")),
            "payment_installments": F.col("payment_installments").try_cast("int"),
            "payment_value": money(F.col("payment_value")),
        }
    )
    unique = keep_one_keyed(clean, ["order_id", "payment_sequential"], _total_order(clean))
    checked = probe(unique, valid_orders, {"order_id": "order_id"}, "_order")
    return flag(
        checked,
        [
            Rule("DQ001", "Order id required", F.col("order_id").isNotNull()),
            Rule("DQ004", "Payment not negative", F.col("payment_value") >= 0),
            Rule("DQ006", "Installments not negative", F.col("payment_installments") >= 0),
            Rule("DQ010", "Order exists", F.col("_order")),
        ],
    ).drop("_order")


def reviews(raw: DataFrame, valid_orders: DataFrame) -> DataFrame:
    clean = raw.withColumns(_trim("review_id", "order_id", "review_comment_title", "review_comment_message")).withColumn(
        "review_score", F.col("review_score").try_cast("int")
    )
    clean = clean.withColumns(_parsed(raw, ["review_creation_date", "review_answer_timestamp"]))
    unique = keep_one_keyed(clean, ["review_id", "order_id"], _total_order(clean))
    checked = probe(unique, valid_orders, {"order_id": "order_id"}, "_order")
    return flag(
        checked,
        [
            Rule("DQ001", "Review and order id required", F.col("review_id").isNotNull() & F.col("order_id").isNotNull()),
            Rule("DQ012", "Score from 1 to 5", F.col("review_score").between(1, 5)),
            Rule("DQ010", "Order exists", F.col("_order")),
        ],
    ).drop("_order")


PARENTS = {
    "categories": [],
    "customers": [],
    "sellers": [],
    "geolocation": [],
    "products": ["categories"],
    "orders": ["customers"],
    "order_items": ["orders", "products", "sellers"],
    "payments": ["orders"],
    "reviews": ["orders"],
}
BUILDERS = {
    "categories": categories,
    "customers": customers,
    "sellers": sellers,
    "geolocation": geolocation,
    "products": products,
    "orders": orders,
    "order_items": order_items,
    "payments": payments,
    "reviews": reviews,
}


class Silver:
    """Flagged frames of the nine entities, built when first asked for, parents before children.

    ``load(entity)`` returns a raw frame. ``settle(entity, flagged)`` may write a flagged frame and
    return the read-back: parents are used by several children, so a batch run settles them instead
    of evaluating them once per child. Without it everything stays one lazy plan.
    """

    def __init__(
        self,
        load: Callable[[str], DataFrame],
        settle: Callable[[str, DataFrame], DataFrame] | None = None,
    ):
        self.load = load
        self.settle = settle or (lambda _entity, frame: frame)
        self._frames: dict[str, DataFrame] = {}

    def flagged(self, entity: str) -> DataFrame:
        if entity not in self._frames:
            parents = [self.valid(p) for p in PARENTS[entity]]
            self._frames[entity] = self.settle(entity, BUILDERS[entity](self.load(entity), *parents))
        return self._frames[entity]

    def valid(self, entity: str) -> DataFrame:
        return valid(self.flagged(entity))
