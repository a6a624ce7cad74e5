"""Raw, all-text entities derived from the given tables, with defects at fixed key positions.

The given tables are clean; the quality rules need something to catch. Every defect depends only
on a key, so the oracle SQL can state the same rows independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import freight, load

# The 27 state codes a valid address may carry.
STATES = (
    "AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO"
).split()

TEXT_TIME = "yyyy-MM-dd HH:mm:ss"
YEARS_SHIFT_MONTHS = 252


def _text(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("string")


def _state(nation_key: str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col(nation_key) + 1)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation table: one category lacks its English name."""
    part = load(spark, sf_dir, "part").select("p_type").distinct()
    english = F.when(F.col("p_type") == "SMALL", F.lit("  ")).otherwise(F.initcap("p_type"))
    return part.select(
        F.concat(F.lit(" "), F.lower("p_type")).alias("product_category_name"),
        F.concat(english, F.lit(" ")).alias("product_category_name_english"),
    ).filter(F.col("p_type") != "PROMO")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = load(spark, sf_dir, "customer")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    key = F.col("c_custkey")
    return joined.select(
        F.concat(F.lit(" "), _text(key)).alias("customer_id"),
        F.when(key % 89 == 0, F.lit("")).otherwise(F.col("c_name")).alias("customer_unique_id"),
        F.lpad(_text(key % 1000), 5, "0").alias("customer_zip_code_prefix"),
        F.concat(F.lower("n_name"), F.lit("  ")).alias("customer_city"),
        F.when(key % 53 == 0, F.lit("xx")).otherwise(F.lower(_state("c_nationkey"))).alias("customer_state"),
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = load(spark, sf_dir, "supplier")
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    key = F.col("s_suppkey")
    return joined.select(
        F.concat(_text(key), F.lit(" ")).alias("seller_id"),
        F.lpad(_text(key % 1000), 5, "0").alias("seller_zip_code_prefix"),
        F.lower("n_name").alias("seller_city"),
        F.when(key % 31 == 0, F.lit("??")).otherwise(_state("s_nationkey")).alias("seller_state"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    category = F.when(key % 29 == 0, F.lit(None).cast("string")).otherwise(F.lower("p_type"))
    return load(spark, sf_dir, "part").select(
        _text(key).alias("product_id"),
        category.alias("product_category_name"),
        F.when(key % 101 == 0, F.lit("n/a")).otherwise(_text(F.length("p_name"))).alias("product_name_lenght"),
        _text(size * 3).alias("product_description_lenght"),
        _text(key % 5).alias("product_photos_qty"),
        F.when(key % 97 == 0, F.lit("-1.00")).when(key % 103 == 0, F.lit("heavy")).otherwise(_text(size * 100)).alias("product_weight_g"),
        F.when(key % 41 == 0, F.lit(None).cast("string")).otherwise(_text(size + 10)).alias("product_length_cm"),
        _text(size + 2).alias("product_height_cm"),
        _text(size + 5).alias("product_width_cm"),
    )


def geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = load(spark, sf_dir, "customer")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    key = F.col("c_custkey")
    return joined.select(
        F.lpad(_text(key % 50), 5, "0").alias("geolocation_zip_code_prefix"),
        _text(((key * 37) % 4300 - 3600).cast("decimal(8,2)") / 100).alias("geolocation_lat"),
        _text(((key * 53) % 4700 - 7600).cast("decimal(8,2)") / 100).alias("geolocation_lng"),
        F.concat(F.lit(" "), F.lower("n_name")).alias("geolocation_city"),
        F.when(key % 67 == 0, F.lit("")).otherwise(_state("c_nationkey")).alias("geolocation_state"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text, moved to 2016 and later; some orders arrive twice (second copy canceled)."""
    key = F.col("o_orderkey")
    copies = F.when(key % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    base = load(spark, sf_dir, "orders").withColumn("_copy", F.explode(copies))
    day = F.col("o_orderdate").cast("date")
    bought = F.when(key % 89 == 0, day).otherwise(F.add_months(day, YEARS_SHIFT_MONTHS))
    days = F.when(key % 71 == 0, F.lit(-3)).otherwise((key % 45).cast("int"))

    def stamp(c: Column) -> Column:
        return F.date_format(c, TEXT_TIME)

    status = (
        F.when(F.col("_copy") == 1, " Canceled")
        .when(key % 61 == 0, "lost")
        .when(F.col("o_orderstatus") == "P", " Shipped")
        .when(F.col("o_orderstatus") == "F", "DELIVERED")
        .otherwise("created ")
    )
    return base.select(
        F.when(key % 211 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), _text(key))).alias("order_id"),
        F.when(key % 151 == 0, F.lit(None).cast("string")).otherwise(_text("o_custkey")).alias("customer_id"),
        status.alias("order_status"),
        F.when(key % 83 == 0, F.lit("not a date")).otherwise(stamp(bought)).alias("order_purchase_timestamp"),
        F.when(F.col("o_orderstatus") != "O", stamp(F.date_add(bought, days))).alias("order_delivered_customer_date"),
        stamp(F.date_add(bought, 30)).alias("order_estimated_delivery_date"),
        (key * 2 + F.col("_copy")).alias("_line"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return load(spark, sf_dir, "lineitem").select(
        _text(key).alias("order_id"),
        F.when(F.col("l_partkey") % 89 == 0, F.lit("0")).otherwise(_text("l_linenumber")).alias("order_item_id"),
        F.concat(_text("l_partkey"), F.lit(" ")).alias("product_id"),
        _text("l_suppkey").alias("seller_id"),
        F.date_format("l_shipdate", TEXT_TIME).alias("shipping_limit_date"),
        F.when(F.col("l_partkey") % 79 == 0, F.concat(F.lit("-"), _text(price))).otherwise(_text(price)).alias("price"),
        F.when(F.col("l_suppkey") % 37 == 0, F.lit("free")).otherwise(_text(freight())).alias("freight_value"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as payments of the order that carries the event's number."""
    key = F.col("event_id")
    kinds = F.array(*[F.lit(x) for x in ("Credit_Card", " boleto", "VOUCHER", "debit_card ")])
    amount = F.col("value").cast("decimal(12,2)")
    return load(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        _text(key).alias("order_id"),
        F.lit("1").alias("payment_sequential"),
        F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int")).alias("payment_type"),
        _text(F.col("user_id") % 12 - 1).alias("payment_installments"),
        F.when(key % 19 == 0, F.lit("abc")).when(key % 23 == 0, F.concat(F.lit("-"), _text(amount + 1))).otherwise(_text(amount)).alias("payment_value"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as review texts; labelled ones get their score raised by one."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id", "left")
    score = F.col("n_chars") % 6 + F.coalesce(F.col("quality"), F.lit(0))
    return joined.select(
        _text("doc_id").alias("review_id"),
        _text(F.col("doc_id") * 3).alias("order_id"),
        _text(score).alias("review_score"),
        F.concat(F.lit(" "), F.col("source")).alias("review_comment_title"),
        F.col("text").alias("review_comment_message"),
    )


def dirty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an uploaded file would look: gaps, placeholders, copies, outliers, bad dates."""
    key = F.col("event_id")
    copies = F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    label = (
        F.when(key % 13 == 0, F.lit(None).cast("string"))
        .when(key % 17 == 0, F.lit("  N/A "))
        .when(key % 19 == 0, F.lit("-"))
        .when(key % 5 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit("\t")))
        .otherwise(F.col("event_type"))
    )
    amount = F.when(key % 11 == 0, F.lit(None).cast("double")).when(key % 97 == 0, F.col("value") + 10000).otherwise(F.col("value"))
    seen = (
        F.when(key % 29 == 0, F.lit("bad date"))
        .when(key % 31 == 0, F.lit(None).cast("string"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    return load(spark, sf_dir, "events").withColumn("_copy", F.explode(copies)).select(
        key.alias("record_id"),
        label.alias("label"),
        amount.alias("amount"),
        F.col("user_id").cast("double").alias("units"),
        seen.alias("seen_on"),
        F.lit("log").alias("origin"),
    )


def order_event_messages(events: DataFrame) -> DataFrame:
    """Event log rows as order messages (JSON in ``value``) with bad fields, broken texts and copies.

    Works on a static frame and on a stream of the event log alike.
    """
    key = F.col("event_id")
    copies = F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    base = events.withColumn("_copy", F.explode(copies))
    price = F.col("value").cast("decimal(12,2)").cast("double")
    body = F.to_json(
        F.struct(
            _text(key).alias("event_id"),
            F.lit("ORDER_ITEM_CREATED").alias("event_type"),
            F.date_format("ts", TEXT_TIME).alias("event_timestamp"),
            F.when(key % 41 != 0, F.concat_ws("-", _text("user_id"), _text(F.floor(key / 3)))).alias("order_id"),
            (key % 3 + 1).cast("int").alias("order_item_id"),
            _text("user_id").alias("customer_id"),
            F.when(key % 47 == 0, -price - 1).otherwise(price).alias("price"),
            (key % 7).cast("double").alias("freight_value"),
            F.when(key % 53 == 0, F.lit(0)).otherwise((key % 3 + 1).cast("int")).alias("quantity"),
            F.col("event_type").alias("order_status"),
            F.lit("replay").alias("source"),
            F.when(key % 43 == 0, F.lit("0.9")).otherwise(F.lit("1.0")).alias("schema_version"),
        )
    )
    return base.select(F.when(key % 59 == 0, F.concat(F.lit("{broken "), _text(key))).otherwise(body).alias("value"))
