"""Hand cases for the firewall, dates, dimensions and versions."""

from __future__ import annotations

import pytest
from frames import rows
from pyspark.sql import functions as F

from tillflow.functions.keys import event_id, packed, surrogate_key, unpacked
from tillflow.operators import rules
from tillflow.operators.dedup import keep_one
from tillflow.operators.integrity import probe
from tillflow.operators.rules import Rule
from tillflow.plans import gold, silver


def test_rule_split_treats_null_as_failure(spark):
    df = spark.createDataFrame(
        [("a", 10.0, "ok"), (None, 5.0, "ok"), ("c", -1.0, "ok"), ("d", 3.0, None)], "order_id string, price double, status string"
    )
    checks = [
        Rule("R1", "id", F.col("order_id").isNotNull()),
        Rule("R2", "price", F.col("price") >= 0),
        Rule("R3", "status", F.col("status").isin("ok")),
    ]
    flagged = rules.flag(df, checks)
    assert rules.valid(flagged).count() == 1
    metric = rules.metrics(flagged, "t").first()
    assert (metric.input_count, metric.valid_count, metric.quarantined_count, metric.quarantine_pct) == (4, 1, 3, 75.0)
    bad = rules.quarantine(flagged, "t", "b1", "2024-01-01T00:00:00Z")
    assert rows(bad, "_dq_rule_id") == [("R1",), ("R2",), ("R3",)]
    again = rules.quarantine(flagged, "t", "b1", "2024-01-01T00:00:00Z")
    assert rows(bad, "_quarantine_id") == rows(again, "_quarantine_id")
    assert rows(rules.rule_counts(flagged), "rule_id", "violations") == [("R1", 1), ("R2", 1), ("R3", 1)]


def test_empty_rule_list_passes_everything(spark):
    df = spark.range(3).toDF("x")
    flagged = rules.flag(df, [])
    assert rules.valid(flagged).count() == 3
    assert rules.metrics(flagged.filter("x < 0"), "t").first().quarantine_pct == 0.0


def test_gate_raises_with_the_name_of_the_gate(spark):
    values = spark.createDataFrame([(2.0, 0)], "quarantine_pct double, variance int")
    out = rules.gates(values, {"quarantine_pct": ("max", 1.0), "variance": ("equal", 0)})
    assert rows(out, "gate", "passed") == [("quarantine_pct", False), ("variance", True)]
    with pytest.raises(rules.GateError, match="quarantine_pct"):
        rules.enforce(out)


def test_keep_one_is_independent_of_row_order(spark):
    data = [("c1", "SP", 1), ("c1", "RJ", 2), ("c2", "MG", 1)]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "customer_id string, state string, seen int").repartition(3)
        assert rows(keep_one(df, ["customer_id"], [F.col("seen")]), "customer_id", "state") == [("c1", "SP"), ("c2", "MG")]


def test_rows_without_a_key_are_rejected_one_by_one(spark):
    from tillflow.operators import rules
    from tillflow.plans import silver

    data = [(None, "u", "1", "x", "SP"), (None, "u", "1", "x", "SP"), (" ", "u", "1", "x", "SP"), ("c1", "u", "1", "x", "SP"), ("c1", "u", "1", "x", "SP")]
    raw = spark.createDataFrame(data, "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string")
    counts = rules.metrics(silver.customers(raw), "customers").first()
    assert (counts.input_count, counts.valid_count, counts.quarantined_count) == (4, 1, 3)


def test_keep_one_limits_a_hot_key_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    plan = keep_one(df, ["k"], [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rows_lost_between_layers_break_a_gate(spark):
    from tillflow.operators.reconcile import layer_account

    n = spark.range
    full = layer_account("e", n(10), n(8), n(5), n(3))
    assert rows(full) == [("e", 10, 2, 5, 3, 0, True)]
    folded = spark.createDataFrame([(4,), (1,)], "samples long")
    assert rows(layer_account("e", n(10), n(8), folded, n(3), "samples")) == rows(full)
    assert rows(layer_account("e", n(0), n(0), folded.limit(0), n(0), "samples")) == [("e", 0, 0, 0, 0, 0, True)]
    for lost in (layer_account("e", n(10), n(8), n(4), n(3)), layer_account("e", n(7), n(8), n(5), n(3))):
        out = rules.gates(lost.select((~F.col("balanced")).cast("int").alias("unbalanced_entities")), {"unbalanced_entities": ("equal", 0)})
        with pytest.raises(rules.GateError, match="unbalanced_entities"):
            rules.enforce(out)


def test_probe_does_not_multiply_children(spark):
    child = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    parent = spark.createDataFrame([(1,), (1,), (3,)], "pk int")
    assert sorted(rows(probe(child, parent, {"k": "pk"}, "hit"), "v", "hit")) == [("x", True), ("y", False), ("z", False)]


def test_delivery_fields(spark):
    df = spark.createDataFrame(
        [("2018-01-01 10:00:00", "2018-01-10 12:00:00", "2018-01-15 00:00:00"), ("2018-01-01 10:00:00", "2018-01-20 12:00:00", "2018-01-15 00:00:00"), ("2018-01-01 10:00:00", None, "2018-01-15 00:00:00")],
        "p string, d string, e string",
    ).select(*[F.col(c).cast("timestamp").alias(c) for c in "pde"])
    out = df.withColumns(silver.delivery_fields(F.col("p"), F.col("d"), F.col("e")))
    got = sorted([(r.delivery_days, r.is_delayed, r.order_year_month) for r in out.collect()], key=str)
    assert got == sorted([(9, False, "2018-01"), (19, True, "2018-01"), (None, None, "2018-01")], key=str)


def test_calendar(spark):
    bounds = spark.sql("select date'2018-01-01' as start, date'2018-01-07' as end")
    out = {r.date_key: r for r in gold.calendar(bounds).collect()}
    assert len(out) == 7
    assert (out[20180101].day_name, out[20180101].quarter, out[20180101].is_weekend) == ("Monday", 1, False)
    assert out[20180106].is_weekend and out[20180107].is_weekend
    whole = spark.sql("select date'2016-01-01' as start, date'2020-12-31' as end")
    assert gold.calendar(whole).count() == 1827


def test_surrogate_key_separates_null_positions(spark):
    df = spark.createDataFrame([(None, "SP"), ("SP", None)], "a string, b string")
    keys = [r[0] for r in df.select(surrogate_key("a", "b")).collect()]
    assert keys[0] != keys[1]


def test_event_id_is_deterministic(spark):
    df = spark.createDataFrame([("ord_1", 1), ("ord_1", 1), ("ord_1", 2)], "o string, i int")
    a, b, c = [r[0] for r in df.select(event_id(F.col("o"), F.col("i"))).collect()]
    assert a == b != c and len(a) == 64


def versions(spark, data):
    df = spark.createDataFrame(data, "customer_id string, state string, at string")
    return df.withColumn("at", F.col("at").cast("timestamp"))


def history(spark, data):
    out = gold.scd2(versions(spark, data), "customer_id", ["state"], "at", F.trunc("at", "month"))
    return sorted((r.customer_id, r.state, r.is_current, str(r.effective_start_date), str(r.effective_end_date)[:10]) for r in out.collect())


def test_scd2_closes_the_old_version(spark):
    got = history(spark, [("c1", "SP", "2016-01-01 00:00:00"), ("c1", "RJ", "2018-06-01 00:00:00")])
    assert got == [("c1", "RJ", True, "2018-06-01 00:00:00", "9999-12-31"), ("c1", "SP", False, "2016-01-01 00:00:00", "2018-06-01")]


def test_scd2_is_independent_of_arrival_order_and_repeats(spark):
    data = [("c1", "SP", "2016-01-01"), ("c1", "SP", "2017-01-01"), ("c1", "RJ", "2018-06-01"), ("c1", "MG", "2018-06-20"), ("c2", "SP", "2017-01-01")]
    assert history(spark, data) == history(spark, data[::-1])
    assert [(r[1], r[2]) for r in history(spark, data) if r[0] == "c1"] == [("MG", True), ("RJ", False), ("SP", False)]


def test_centroid_city_is_most_frequent_then_alphabetical(spark):
    df = spark.createDataFrame(
        [("1", "SP", "B", -10.0, -40.0), ("1", "SP", "A", -12.0, -42.0), ("1", "SP", "C", -11.0, -41.0), ("1", "SP", "C", -11.0, -41.0), ("2", "SP", "Z", 0.0, -50.0), ("2", "SP", "Y", 1.0, -50.0)],
        "geolocation_zip_code_prefix string, geolocation_state string, geolocation_city string, geolocation_lat double, geolocation_lng double",
    )
    out = rows(silver.centroids(df), "geolocation_zip_code_prefix", "geolocation_city", "latitude", "_coordinate_samples_count")
    assert out == [("1", "C", -11.0, 4), ("2", "Y", 0.5, 2)]


def test_fact_joins_the_widest_dimension_last(spark):
    """Keys of a dimension move along in every join after its own, so the customer's two come last."""
    from tillflow.plans import gold

    items = spark.createDataFrame([("o", 1, "p", "s", 1, 1, "2024-01")], "order_id string, order_item_id int, product_id string, seller_id string, price int, freight_value int, order_year_month string")
    orders = spark.createDataFrame([("o", "c")], "order_id string, customer_id string")
    for c in ("order_status", "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date", "delivery_days", "is_delayed", "order_year_month"):
        orders = orders.selectExpr("*", f"cast(null as {'timestamp' if c.endswith(('timestamp', 'date')) else 'string'}) AS {c}")
    dims = [spark.createDataFrame([(k[0], "x", "y")], f"{k}_id string, {k}_key string, location_key string") for k in ("customer", "product", "seller")]
    fact = gold.fact_sales(items, orders, *dims, "2024-02-01 00:00:00")
    joins = [line for line in fact._jdf.queryExecution().analyzed().toString().splitlines() if "Join LeftOuter" in line]
    assert ["customer_id" in j for j in joins] == [True, False, False]


def test_packed_keys_come_back(spark):
    digest = "0123456789abcdef" * 4
    texts = [digest, digest.upper(), digest + "\n", digest[:63], digest[:31], digest[:16], "x", "é=", "", "\u0000", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", packed("t"))
    got = df.select("i", F.octet_length("p").alias("n"), unpacked("p").alias("back")).orderBy("i").collect()
    assert [r.back for r in got] == texts
    assert [r.n == 32 for r in got] == [True, *[False] * 10]


def fact_frames(spark, items, orders, *dims):
    lines = spark.createDataFrame(items, "order_id string, order_item_id int, product_id string, seller_id string, price decimal(12,2), freight_value decimal(12,2), order_year_month string")
    days = spark.createDataFrame(orders, "order_id string, customer_id string, order_purchase_timestamp timestamp").selectExpr(
        "*", "'created' AS order_status", *[f"cast(null AS timestamp) AS order_{c}" for c in ("delivered_customer_date", "estimated_delivery_date")], "1 AS delivery_days", "false AS is_delayed", "'none' AS order_year_month"
    )
    names = ("customer", "product", "seller")
    return lines, days, *[spark.createDataFrame(d, f"{n}_id string, {n}_key string" + ", location_key string" * (n == "customer")) for n, d in zip(names, dims, strict=True)]


def test_fact_keeps_items_with_an_order_and_gives_keys_as_stored(spark):
    from datetime import datetime
    from decimal import Decimal

    day, hashed = datetime(2024, 1, 2), "0123456789abcdef" * 4
    items = [(o, n, p, s, Decimal(1), Decimal(2), "2024-01") for o, n, p, s in [("a", 1, "p", "s"), ("a", 2, None, "t"), ("b", 1, "q", None), ("lost", 1, "p", "s"), (None, 1, "p", "s")]]
    orders = [("a", "c", day), ("b", None, day), ("b", "d", day), ("empty", "c", day), (None, "c", day)]
    frames = fact_frames(spark, items, orders, [("c", hashed, "place"), ("d", "plain", None), ("d", hashed.upper(), "")], [("p", hashed)], [("s", "key"), ("t", None)])
    fact = gold.fact_sales(*frames, "2024-02-01 00:00:00")
    got = fact.select("order_id", "order_item_id", "customer_key", "location_key", "product_key", "seller_key", "order_year_month").collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(
        [
            ("a", 1, hashed, "place", hashed, "key", "2024-01"),
            ("a", 2, hashed, "place", None, None, "2024-01"),
            ("b", 1, None, None, None, None, "2024-01"),
            ("b", 1, "plain", None, None, None, "2024-01"),
            ("b", 1, hashed.upper(), "", None, None, "2024-01"),
        ],
        key=str,
    )
    numbered = gold.fact_sales(*frames[:3], frames[3].withColumn("product_key", F.lit(7)), frames[4], "2024-02-01 00:00:00")
    assert {r.product_key for r in numbered.select("product_key").collect()} == {7, None}


def test_fact_finds_customers_per_order_and_streams_items(spark):
    """No item moves to its customer, and the join with orders keeps items, the side of many rows, streamed."""
    fact = gold.fact_sales(*fact_frames(spark, [], [], [], [], []), "2024-02-01 00:00:00")
    joins = [line.strip(" :+-") for line in fact._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    kinds = ["Join RightOuter, (order_id", "Join LeftOuter, (customer_id", "Join LeftOuter, (seller_id", "Join LeftOuter, (product_id"]
    assert len(joins) == 4 and all(j.startswith(k) for j, k in zip(joins, kinds, strict=True))


def test_written_frames_free_their_shuffles(spark):
    import time

    from tillflow.session import FREE_SHUFFLES, materialize

    def shuffles():
        kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (kept.apply(i).getName() for i in range(kept.size())) if name.startswith("shuffle_")}

    df, before = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), shuffles()
    set_to = spark.conf.get(FREE_SHUFFLES, None)
    assert len(materialize(df, "freed", free_shuffles=True).collect()) == 7
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(FREE_SHUFFLES, None) == set_to
