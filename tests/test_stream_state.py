"""Events over several micro-batches equal the batch twin, whatever the order of arrival."""

import itertools
import json

import pytest
from frames import rows

from tillflow.operators import rules
from tillflow.streaming import orders as so


def message(event, at, price, order, **more):
    body = {"event_id": event, "event_type": so.EVENT_TYPE, "event_timestamp": at, "order_id": order, "order_item_id": 1, "price": price, "freight_value": 1.0, "quantity": 2, "order_status": "paid", "schema_version": so.EVENT_VERSION}
    return json.dumps({**body, **more})


#: Copies of e1 differ in time and order, copies of e2 in text alone; e3 comes three times over; one is rejected, one unreadable.
A = [message("e1", "2024-01-01 10:06:00", 5.0, "o1"), message("e2", "2024-01-01 10:00:00", 7.0, "o2"), message("e3", "2024-01-01 10:20:00", 1.0, "o2"), "{broken"]
B = [message("e1", "2024-01-01 10:01:00", 6.0, "o3"), message("e3", "2024-01-01 10:20:00", 1.0, "o2"), message("e4", "2024-01-01 10:02:00", -1.0, "o4")]
C = [message("e2", "2024-01-01 10:00:00", 4.0, "o5"), message("e3", "2024-01-01 10:20:00", 1.0, "o2"), message("e1", "2024-01-01 10:08:00", 9.0, "o1"), None]


@pytest.fixture(scope="module")
def twin(spark):
    checked = so.check(so.parse(spark.createDataFrame([(v,) for v in A + B + C], "value string")))
    silver = so.deduplicate(rules.valid(checked))
    assert sorted((r.event_id, r.order_id) for r in silver.collect()) == [("e1", "o3"), ("e2", "o2"), ("e3", "o2")]
    return rows(so.sliding(silver)), rows(so.kpis(checked))


@pytest.mark.parametrize("arrivals", list(itertools.permutations((A, B, C)))[::2])
def test_three_arrivals_equal_the_batch_twin(spark, tmp_path, twin, arrivals):
    root = str(tmp_path)
    for values in arrivals:
        spark.createDataFrame([(v,) for v in values], "value string").write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema("value string").parquet(f"{root}/log")
        so.run_batches(so.changes(so.check(so.parse(stream)), "1 day"), so.write_changes(root), f"{root}/checkpoint", "update")
    read = spark.read.parquet
    sliding, kpis = twin
    assert rows(so.merged_sliding(read(f"{root}/sliding"))) == sliding
    assert rows(so.merged_kpis(read(f"{root}/orders"), read(f"{root}/counts"))) == kpis
    assert read(f"{root}/quarantine").count() == 3


def test_ids_share_the_state_of_their_part(spark, tmp_path, monkeypatch):
    """State rows, one Python call each, stay at the number of parts; ids leave a part one by one."""
    monkeypatch.setattr(so, "STATE_PARTS", 3)
    root = str(tmp_path)
    days = [[message(f"a{i}", "2024-01-01 10:00:00", 2.0, "o1") for i in range(40)], [message(f"b{i}", "2024-01-03 10:00:00", 3.0, "o2") for i in range(20)], [message("b1", "2024-01-03 09:30:00", 1.0, "o3")]]
    for values in days:
        spark.createDataFrame([(v,) for v in values], "value string").write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema("value string").parquet(f"{root}/log")
        query = so.run_batches(so.changes(so.check(so.parse(stream)), "1 hour"), so.write_changes(root), f"{root}/checkpoint", "update")
        states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        assert states and max(states) <= 3
    signs = spark.read.parquet(f"{root}/changes").where("event_id = 'b1'").select("sign").collect()
    assert sorted(r.sign for r in signs) == [-1, 1, 1]
    assert rows(so.merged_kpis(spark.read.parquet(f"{root}/orders"), spark.read.parquet(f"{root}/counts")))[0][:4] == (61, 60, 0, 1)
