"""Files, writes, versions, audit replay and streaming, on small inputs."""

from __future__ import annotations

import hashlib
import random
from collections import deque

import pytest
from frames import rows
from pyspark.sql import functions as F

from tillflow import raw
from tillflow.operators import audit, replay, rules
from tillflow.plans.medallion import BatchRun
from tillflow.queries import QUERIES
from tillflow.queries.stream import batch_events
from tillflow.sources import bronze, files, versions
from tillflow.streaming import orders as so


def test_csv_scan_keeps_text(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id, name ,n\n1,"a ""b""\nc",3\n2,x,\n'.encode())
    df = files.read_csv(spark, str(path))
    assert df.columns == ["id", "name", "n"] and {t for _, t in df.dtypes} == {"string"}
    assert [(r.id, r.name) for r in df.orderBy("id").collect()] == [("1", 'a "b"\nc'), ("2", "x")]


def test_sanitize_names():
    assert files.sanitize_names([" a\x01 ", None, "a", "", "x" * 200]) == ["a", "unnamed_column_2", "a_1", "unnamed_column_4", "x" * 128]


def test_guards(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("a,b\n")
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    status = {n: files.input_status(spark, str(tmp_path / n)) for n in ("empty.csv", "header.csv", "ok.csv", "none.csv")}
    assert status == {"empty.csv": "EMPTY_FILE", "header.csv": "NO_ROWS", "ok.csv": "OK", "none.csv": "MISSING"}
    with pytest.raises(files.InputError, match="none"):
        files.guard(spark, {"none": str(tmp_path / "none.csv")})
    with pytest.raises(files.InputError, match="b"):
        files.require_columns(spark.range(1), "t", ["id", "b"])


def test_delimiter_vote(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a;b;c\n1,5;x;y\n2,7;x;z\n")
    assert files.sniff_delimiter(spark, str(tmp_path / "s.csv")) == ";"


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    assert files.fingerprint(df).first() == files.fingerprint(df.orderBy(F.col("id").desc()).repartition(7)).first()
    doubled = df.filter("id < 2").unionAll(df.filter("id < 2"))
    assert files.fingerprint(doubled).first().hash_sum != files.fingerprint(doubled.limit(0)).first().hash_sum


def test_writes_are_idempotent(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("p"))
    for _ in range(2):
        out = bronze.write_with_variance(df, str(tmp_path / "t"), "t", ["p"]).first()
    assert (out.source_rows, out.written_rows, out.variance) == (10, 10, 0)
    versions.backfill(df.withColumn("id", F.lit(7).cast("bigint")), str(tmp_path / "t"), "p", 1, 1)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("p = 1").distinct().count() == 1 and back.filter("p = 0").count() == 5


def test_upsert_twice_is_upsert_once(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "B", 2), (3, "c", 1), (1, "old", 0)], "k int, v string, ver int")
    once = versions.upsert(base, new, ["k"], "ver")
    assert rows(once) == [(1, "a", 1), (2, "B", 2), (3, "c", 1)] == rows(versions.upsert(once, new, ["k"], "ver"))


def test_snapshots(spark, tmp_path):
    df = spark.range(5)
    versions.save_version(df, str(tmp_path), "d", 0, [])
    versions.save_version(df.filter("id > 2"), str(tmp_path), "d", 1, [{"action": "x"}])
    assert versions.load_version(spark, str(tmp_path), "d", 0).count() == 5
    assert versions.load_version(spark, str(tmp_path), "d").count() == 2


# --- audit replay against a plain loop ---------------------------------------------------------------------


def log(spark, seed, n=400):
    rng = random.Random(seed)
    t, data = 0.0, []
    for i in range(n):
        t += rng.choice([1, 1, 2, 5, 30, 200])
        data.append((i, rng.choice(["a", "a", "a", "b"]), float(t)))
    df = spark.createDataFrame(data, "event_id int, k string, s double")
    return data, df.select("event_id", "k", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")).alias("ts")).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limit_matches_a_loop(spark, seed):
    data, df = log(spark, seed)
    want, seen = {}, {"a": deque(), "b": deque()}
    for i, k, s in data:
        q = seen[k]
        while q and q[0] <= s - 60:
            q.popleft()
        want[i] = len(q) < 5
        if want[i]:
            q.append(s)
    got = {r.event_id: r.allowed for r in audit.rate_limit(df, ["k"], "ts", "event_id", 5, 60).collect()}
    assert got == want and not all(got.values())


def test_lockout_matches_a_loop(spark):
    data, df = log(spark, 7)
    want, state = {}, {}
    for i, k, s in data:
        count, first = state.get(k, (0, s))
        if s - first > 60:
            count, first = 0, s
        state[k] = (count + 1, first)
        want[i] = count + 1
    got = {r.event_id: r.failed_count for r in audit.lockouts(df, ["k"], "ts", "event_id", 3, 60).collect()}
    assert got == want


def limited(data, limit, window):
    """The limiter as a plain loop over (event_id, key, seconds) in order."""
    out, seen = {}, {}
    for i, k, s in data:
        q = seen.setdefault(k, deque())
        while q and q[0] <= s - window:
            q.popleft()
        out[i] = len(q) < limit
        if out[i]:
            q.append(s)
    return out


def timed(spark, data):
    df = spark.createDataFrame(data, "event_id int, k string, s int")
    return df.select("event_id", "k", F.timestamp_micros(F.col("s").cast("bigint") * 1_000_000).alias("ts")).repartition(5)


@pytest.mark.parametrize("limit, gaps", [(5, [0, 1, 2, 3, 9]), (3, [0, 0, 4, 7]), (1, [30])])
def test_rate_limit_of_a_run_without_a_pause(spark, limit, gaps):
    """One key is busy for many blocks, NULL is a key; requests every 30 s against one in 60 s never forget their start."""
    rng = random.Random(limit)
    s, data = 30, [(9000, "hot", 0)] if limit == 1 else []
    for i in range(1500):
        s += rng.choice(gaps)
        data.append((i, "hot" if rng.random() < 0.9 or limit == 1 else None, s))
    got = {r.event_id: r.allowed for r in audit.rate_limit(timed(spark, data), ["k"], "ts", "event_id", limit, 60, block=2).collect()}
    assert got == limited(data, limit, 60) and 0.01 < sum(got.values()) / len(got) < 0.99


def test_unsettled_blocks_are_played_in_sequence(spark, monkeypatch):
    """Blocks in which the phase of the accepted requests stays what it was on entry: no round settles them all."""
    monkeypatch.setattr(replay, "ROUNDS", 1)
    data = [(i, "hot", 20 + 25 * i) for i in range(400)] + [(1000 + i, "calm", 500 * i) for i in range(20)]
    got = {r.event_id: r.allowed for r in audit.rate_limit(timed(spark, data), ["k"], "ts", "event_id", 1, 60, block=1).collect()}
    assert got == limited(data, 1, 60)


def test_lockouts_of_long_runs(spark):
    rng = random.Random(3)
    s, data, want, state = 0, [], {}, {}
    for i in range(900):
        s += rng.choice([0, 1, 7, 20, 40] if i < 700 else [10, 70])
        k = rng.choice(["hot", "hot", "hot", None])
        data.append((i, k, s))
        first, n = state.get(k, (s, 0))
        first, n = (s, 0) if s - first > 60 else (first, n)
        state[k] = (first, n + 1)
        want[i] = n + 1
    found = audit.lockouts(timed(spark, data), ["k"], "ts", "event_id", 3, 60, block=2).collect()
    assert {r.event_id: r.failed_count for r in found} == want
    assert all((r.locked_until is not None) == (r.failed_count >= 3) for r in found)
    assert audit.lockouts(timed(spark, data).limit(0), ["k"], "ts", "event_id", 3, 60).count() == 0
    assert audit.rate_limit(timed(spark, data).limit(0), ["k"], "ts", "event_id", 3, 60).count() == 0


def test_trailing_count_matches_a_loop(spark):
    data, df = log(spark, 3)
    got = {r.event_id: r.trailing_count for r in audit.trailing_count(df, ["k"], "ts", 60).collect()}
    assert got == {i: sum(1 for _, k2, s2 in data if k2 == k and s - 60 < s2 <= s) for i, k, s in data}


def test_trailing_count_reads_a_row_once_however_dense_the_window(spark):
    """A sliding frame would add up the whole window again for every row."""
    data = [(i, "hot" if i % 3 else None, i // 40) for i in range(3000)]
    counted = audit.trailing_count(timed(spark, data), ["k"], "ts", 60)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" in plan and "RangeFrame, -" not in plan
    t = {}
    for _, k, s in data:
        t.setdefault(k, []).append(s)
    assert {r.event_id: r.trailing_count for r in counted.collect()} == {i: sum(s - 60 < x <= s for x in t[k]) for i, k, s in data}


def test_replay_takes_dense_requests_and_sends_no_arrays(spark):
    """Thousands of requests in one window, at equal times too; states reach Python as text."""
    data = [(i, "hot" if i % 7 else None, i // 25) for i in range(4000)]
    got = {r.event_id: r.allowed for r in audit.rate_limit(timed(spark, data), ["k"], "ts", "event_id", 5, 60, block=1).collect()}
    assert got == limited(data, 5, 60) and sum(got.values()) < 100
    rows = spark.createDataFrame([("a", 0, 1, 7)], "_who string, _block bigint, _t bigint, event_id int")
    states = spark.createDataFrame([("a", 0, [5])], "_who string, _block bigint, _state array<bigint>")
    laid = replay._laid(rows, states, ["event_id"])
    assert [r._state for r in laid.collect()] == ["[5]", None]
    assert not [f.name for f in laid.schema.fields if f.dataType.typeName() == "array"]


def test_hash_chain_finds_the_first_break(spark):
    data, df = log(spark, 4, 60)
    fields = ["event_id", "k"]
    chained = audit.chain_log(df, ["k"], ["ts", "event_id"], fields)
    assert all(r.valid for r in audit.verify_chain(chained, ["k"], fields).collect())
    first = [i for i, k, _ in data if k == "a"]
    line = chained.filter("k = 'a' and position = 0").select(audit.content(fields), "event_hash").first()
    assert line[1] == hashlib.sha256(f"{line[0]}:{audit.GENESIS}".encode()).hexdigest()
    forged = chained.withColumn("event_id", F.when(F.col("event_id") == first[4], 999).otherwise(F.col("event_id")))
    state = {r.k: (r.valid, r.first_broken) for r in audit.verify_chain(forged, ["k"], fields).collect()}
    assert state == {"a": (False, 4), "b": (True, None)}
    gone = chained.filter("not (k = 'a' and position = 5)")
    assert {r.k: r.first_broken for r in audit.verify_chain(gone, ["k"], fields).collect()}["a"] == 6


# --- events -----------------------------------------------------------------------------------------------


def message(**change):
    event = dict(
        event_id="e1", event_type="ORDER_ITEM_CREATED", event_timestamp="2024-01-01 10:00:00", order_id="o1", order_item_id=1, customer_id="c", product_id="p",
        seller_id="s", price=150.75, freight_value=1.0, quantity=1, order_status="delivered", source="t", schema_version="1.0",
    )
    import json

    return (json.dumps({**event, **change}),)


def test_event_rules_and_duplicates(spark):
    data = [message(), message(event_id="e2", price=-50), message(event_id="e3", order_id=None), message(event_id="e4", quantity=0), message(), ("{broken",)]
    checked = so.check(so.parse(spark.createDataFrame(data, "value string")))
    good = rules.valid(checked)
    assert good.count() == 2 and so.deduplicate(good).count() == 1
    k = so.kpis(checked).first()
    assert (k.input_events, k.valid_events, k.quarantined_events, k.duplicate_events, k.gross_revenue) == (6, 1, 4, 1, 151.75)
    kept = checked.filter(F.size(rules.IDS) > 0).select("value").collect()
    assert ("{broken",) in [tuple(r) for r in kept]


def test_stream_windows_equal_the_batch(spark, sf):
    for stream, batch in (("stream_tumbling", "tumbling_batch"), ("stream_sliding", "sliding_batch")):
        found = QUERIES[stream](spark, sf)
        assert rows(found) and rows(found) == rows(QUERIES[batch](spark, sf).select(*found.columns))


def test_restart_adds_nothing(spark, sf):
    out = QUERIES["stream_restart"](spark, sf).collect()
    assert all(r.events == r.distinct_events for r in out)


def test_dedup_twin(spark, sf):
    assert rows(QUERIES["stream_dedup"](spark, sf), "event_id") == rows(batch_events(spark, sf), "event_id")


# --- the batch run ------------------------------------------------------------------------------------------


def test_batch_run_is_repeatable_and_gated(spark, sf, tmp_path):
    def load(entity):
        return getattr(raw, entity)(spark, sf)

    run = BatchRun(spark, str(tmp_path), "batch_1", "2024-02-01 00:00:00")
    with pytest.raises(rules.GateError, match="quarantine_pct"):
        run.run(load)
    first = {n: rows(df.select(sorted(df.columns))) for n, df in run.reports.items()}
    rejected = spark.read.parquet(run.path("quarantine", "orders")).count()
    again = BatchRun(spark, str(tmp_path), "batch_1", "2024-02-01 00:00:00")
    reports = again.run(load, limit_pct=60.0)
    assert {n: rows(df.select(sorted(df.columns))) for n, df in reports.items() if n != "gates"} == {n: r for n, r in first.items() if n != "gates"}
    assert spark.read.parquet(again.path("quarantine", "orders")).count() == rejected
    assert reports["reconciliation"].first().reconciliation_status == "EXACT_MATCH"
    accounts = reports["accounting"].collect()
    assert len(accounts) == 9 and all(a.balanced for a in accounts) and sum(a.rejected_rows for a in accounts) > 0 < sum(a.duplicate_rows for a in accounts)
    metric = reports["fact_metrics"].first()
    assert metric.grain_violations_count == 0 and metric.fact_row_count > 0


LANDING = {
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c1,Delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,,2018-01-09 10:00:00,2018-01-20 00:00:00\n"
    "o2,c2,shipped,2018-02-01 10:00:00,,,,2018-02-20 00:00:00\n"
    "o3,c9,shipped,2018-02-02 10:00:00,,,,2018-02-20 00:00:00\n"
    "o1,c1,Delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,,2018-01-09 10:00:00,2018-01-20 00:00:00\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    "o1,1,p1,s1,2018-01-05 00:00:00,100.00,15.50\no1,2,p1,s1,2018-01-05 00:00:00,50.00,0.00\no2,1,p1,s9,2018-02-05 00:00:00,10.00,1.00\n",
    "products": "product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
    "p1,brinquedos,10,20,1,500,10,20,30\n",
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,01310,sao paulo,sp\nc2,u2,22041,rio,RJ\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,Credit_Card,1,165.50\n",
    "reviews": "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
    'r1,o1,5,,"good\n""stuff""",2018-01-10 00:00:00,2018-01-11 00:00:00\nr2,o1,9,,,2018-01-10 00:00:00,\n',
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01310,sao paulo,SP\n",
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n01310,-23.5,-46.6,sao paulo,SP\n01310,48.8,2.3,paris,SP\n",
    "categories": "product_category_name,product_category_name_english\nbrinquedos,toys\n",
}


def test_batch_run_over_csv_files(spark, tmp_path):
    for entity, text in LANDING.items():
        (tmp_path / f"{entity}.csv").write_text(text)
    run = BatchRun(spark, str(tmp_path / "lake"), "b1", "2024-02-01 00:00:00")
    reports = run.run(lambda e: files.read_csv(spark, str(tmp_path / f"{e}.csv")), limit_pct=60.0)
    quality = {r.entity: (r.input_count, r.quarantined_count) for r in reports["quality"].collect()}
    assert quality["orders"] == (3, 1) and quality["order_items"] == (3, 1) and quality["reviews"] == (2, 1) and quality["geolocation"] == (2, 1)
    fact = run.read("gold", "fact_sales").orderBy("order_item_id").collect()
    assert [(float(r.total_item_value), r.order_date_key, r.delivery_days, r.is_delayed) for r in fact] == [(115.5, 20180101, 8, False), (50.0, 20180101, 8, False)]
    assert run.read("gold", "dim_product").first().product_category_name == "toys"
    assert reports["reconciliation"].first().reconciliation_status == "EXACT_MATCH"


def test_batch_run_refuses_unusable_files(spark, tmp_path):
    paths = {entity: str(tmp_path / f"{entity}.csv") for entity in LANDING}
    for entity, text in LANDING.items():
        (tmp_path / f"{entity}.csv").write_text({"sellers": "", "reviews": text.splitlines()[0] + "\n"}.get(entity, text))
    (tmp_path / "payments.csv").rename(tmp_path / "other.csv")
    run = BatchRun(spark, str(tmp_path / "lake"), "b1", "2024-02-01 00:00:00")
    with pytest.raises(files.InputError, match="payments: MISSING; reviews: NO_ROWS; sellers: EMPTY_FILE"):
        run.run_files(paths, limit_pct=60.0)
    for entity, text in LANDING.items():
        (tmp_path / f"{entity}.csv").write_text(text.replace("seller_city", "town").replace("payment_value", "amount"))
    with pytest.raises(files.InputError, match="payments: lacks payment_value; sellers: lacks seller_city|sellers: lacks seller_city; payments: lacks payment_value"):
        run.run_files(paths, limit_pct=60.0)
    assert not (tmp_path / "lake").exists()
    for entity, text in LANDING.items():
        (tmp_path / f"{entity}.csv").write_text(text)
    run.run_files(paths, limit_pct=60.0)
    assert run.read("bronze", "orders").select("_source_file").distinct().first()[0] == "orders.csv"
    stamps = run.read("gold", "fact_sales").select(F.date_format("_processed_at", "yyyy-MM-dd HH:mm:ss")).distinct().collect()
    assert [r[0] for r in stamps] == ["2024-02-01 00:00:00"] and len(run.read("gold", "fact_sales").columns) == 21


def test_a_rerun_leaves_nothing_behind(spark, tmp_path):
    from tillflow.sources import bronze, versions

    def frame(*data):
        return spark.createDataFrame(list(data), "m int, v string")

    path = str(tmp_path / "t")
    bronze.write_table(frame((1, "a"), (2, "b"), (3, "c"), (4, "d")), path, ["m"])
    versions.backfill(frame((2, "x"), (9, "out of range")), path, "m", 2, 3)
    assert rows(spark.read.parquet(path), "m", "v") == [(1, "a"), (2, "x"), (4, "d")]
    versions.backfill(spark.read.parquet(path), path, "m", 1, 2)
    assert rows(spark.read.parquet(path), "m", "v") == [(1, "a"), (2, "x"), (4, "d")]
    bronze.write_table(frame((2, "y")), path, ["m"])
    assert rows(spark.read.parquet(path), "m", "v") == [(2, "y")]


def test_a_replay_without_rejects_empties_its_quarantine(spark, tmp_path):
    from tillflow.sources import bronze

    path, bad = str(tmp_path / "q"), spark.createDataFrame([("r", "2024-02-01", "b")], "v string, _rejection_date string, _processing_batch_id string")
    for batch in ("b1", "b2"):
        bronze.write_quarantine(bad, path, batch, "2024-02-01 00:00:00")
    bronze.write_quarantine(bad.limit(0), path, "b1", "2024-02-01 00:00:00")
    assert rows(spark.read.parquet(path), "v", "_processing_batch_id") == [("r", "b2")]


def test_clean_names_are_unique_and_short():
    names = files.sanitize_names(["a", "a", "a_1", "A", "x" * 130, "x" * 129, None])
    assert names == ["a", "a_1", "a_1_1", "A_2", "x" * 128, "x" * 126 + "_1", "unnamed_column_7"]
    assert len({n.lower() for n in names}) == len(names) and max(map(len, names)) == 128


def test_late_routing_keeps_events_without_a_time(spark, tmp_path):
    from tillflow.streaming import orders as so

    root, handle = str(tmp_path), so.route_late(str(tmp_path))
    rows = [[("a", "2024-01-01 10:00:00"), ("b", None)], [("c", "2024-01-01 09:00:00"), ("d", "2024-01-01 10:05:00"), ("e", None)]]
    for number, batch in enumerate(rows):
        handle(spark.createDataFrame(batch, "event_id string, t string").selectExpr("event_id", "CAST(t AS timestamp) AS event_timestamp"), number)
    found = {kind: sorted(r["event_id"] for r in spark.read.parquet(f"{root}/{kind}").collect()) for kind in ("on_time", "late", "undated")}
    assert found == {"on_time": ["a", "d"], "late": ["c"], "undated": ["b", "e"]}


def test_histogram_of_one_price(spark):
    from tillflow.plans.baskets import price_histogram

    rows = price_histogram(spark.createDataFrame([(5.0,), (5.0,), (None,)], "price double"), "price", 10).collect()
    assert sorted((r["bucket"], r["items"]) for r in rows if r["bucket"] is not None) == [(1, 2)]


def test_scratch_needs_a_shared_folder_off_one_machine():
    from tillflow.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError):
        shared_dir(type("S", (), {"conf": Conf()})(), "x")
