"""Order events: contract, checks, deduplication, windows, sinks and routing of late events.

Every step is a function from frame to frame that works on a stream and on a batch alike, so the
batch twin of a streaming query is the same code on a static frame.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.dates import parse_timestamp, year_month
from ..functions.keys import event_id
from ..functions.numbers import mean_money, money
from ..operators import rules
from ..operators.rules import Rule

EVENT_SCHEMA = (
    "event_id string, event_type string, event_timestamp string, order_id string, order_item_id int, customer_id string, "
    "product_id string, seller_id string, price double, freight_value double, quantity int, order_status string, source string, "
    "schema_version string"
)
EVENT_TYPE = "ORDER_ITEM_CREATED"
EVENT_VERSION = "1.0"
WATERMARK = "10 minutes"
LATE_SECONDS = 600
WINDOW, SLIDE = "10 minutes", "5 minutes"


def fact_to_events(fact: DataFrame) -> DataFrame:
    """Sales fact rows as JSON events: the id is a hash of order and item, so replays repeat it."""
    def known(c: str, unknown: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(unknown))

    fields = F.struct(
        event_id(F.col("order_id"), F.col("order_item_id")).alias("event_id"),
        F.lit(EVENT_TYPE).alias("event_type"),
        F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss").alias("event_timestamp"),
        F.col("order_id").cast("string").alias("order_id"),
        F.col("order_item_id").cast("int").alias("order_item_id"),
        known("customer_key", "cust_unknown").alias("customer_id"),
        known("product_key", "prod_unknown").alias("product_id"),
        known("seller_key", "seller_unknown").alias("seller_id"),
        F.coalesce(F.col("item_price").cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(F.col("freight_value").cast("double"), F.lit(0.0)).alias("freight_value"),
        F.coalesce(F.col("order_item_quantity").cast("int"), F.lit(1)).alias("quantity"),
        F.coalesce(F.col("order_status"), F.lit("delivered")).alias("order_status"),
        F.lit("replay").alias("source"),
        F.lit(EVENT_VERSION).alias("schema_version"),
    )
    return fact.select(F.to_json(fields).alias("value"))


def parse(raw: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Typed events from the JSON in ``value``; the text stays, so a malformed event keeps its evidence.

    The fields leave the parsed struct through ``inline``: a filter on them stays above it. Fields
    selected from the struct would be inlined into the pushed filter, one parse of the text per rule.
    carried: further columns to keep.
    """
    text = raw.select(F.col("value").cast("string").alias("value"), *carried)
    typed = text.select("value", *carried, F.inline_outer(F.array(F.from_json("value", EVENT_SCHEMA)))).withColumns(
        {"event_timestamp": parse_timestamp("event_timestamp"), "price": money(F.col("price")), "freight_value": money(F.col("freight_value"))}
    )
    return typed.withColumns(
        {
            "total_amount": (F.col("price") + F.col("freight_value")).cast("decimal(12,2)"),
            "order_year_month": year_month("event_timestamp"),
        }
    )


def event_rules() -> list[Rule]:
    return [
        Rule("EV01", "Event id required", F.col("event_id").isNotNull()),
        Rule("EV02", "Order id required", F.col("order_id").isNotNull()),
        Rule("EV03", "Item number from 1", F.col("order_item_id") >= 1),
        Rule("EV04", "Price not negative", F.col("price") >= 0),
        Rule("EV05", "Freight not negative", F.col("freight_value") >= 0),
        Rule("EV06", "Quantity from 1", F.col("quantity") >= 1),
        Rule("EV07", "Event type known", F.col("event_type") == EVENT_TYPE),
        Rule("EV08", "Schema version known", F.col("schema_version") == EVENT_VERSION),
    ]


def check(parsed: DataFrame) -> DataFrame:
    return rules.flag(parsed, event_rules())


def deduplicate(valid: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """One event per id: of a batch the least copy, by time, then by text. On a stream, which must answer before later
    copies come, the first to arrive; the watermark bounds the state. ``changes`` holds the least copy on a stream."""
    if valid.isStreaming:
        return valid.withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])
    rest = [c for c in valid.columns if c not in ("event_id", "event_timestamp", "value")]
    least = F.min(F.struct("event_timestamp", "value", *rest)).alias("_least")
    return valid.groupBy("event_id").agg(least).select("event_id", "_least.*").select(*valid.columns)


def _finish(df: DataFrame, keys: list[str]) -> DataFrame:
    amounts = ("total_product_revenue", "total_freight_revenue", "total_gross_revenue")
    return df.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *keys,
        "events_count",
        "unique_orders_count",
        "total_units_sold",
        *[F.col(c).cast("double").alias(c) for c in amounts],
        mean_money(F.col("total_product_revenue"), F.col("events_count")).alias("avg_item_price"),
        mean_money(F.col("total_gross_revenue"), F.col("unique_orders_count")).alias("avg_order_value"),
    )


def order_parts(events: DataFrame, slide: str, keys: list[str]) -> DataFrame:
    """Sums per (window, order): small enough to merge later, so distinct orders stay exact.

    On a stream this is the only stateful fold; its states are read back and folded by ``fold_parts``.
    """
    return events.groupBy(F.window("event_timestamp", WINDOW, slide).alias("w"), "order_id", *keys).agg(
        F.count("event_id").alias("n"), F.sum("quantity").alias("q"), F.sum("price").alias("p"), F.sum("freight_value").alias("f"), F.sum("total_amount").alias("g")
    )


def fold_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Window totals from parts that hold every (window, order) once."""
    folded = parts.groupBy("w", *keys).agg(
        F.sum("n").alias("events_count"),
        F.count("order_id").alias("unique_orders_count"),
        F.sum("q").alias("total_units_sold"),
        F.sum("p").alias("total_product_revenue"),
        F.sum("f").alias("total_freight_revenue"),
        F.sum("g").alias("total_gross_revenue"),
    )
    return _finish(folded, keys)


def merge_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of several batches, each over its own events, as one part per (window, order)."""
    return parts.groupBy("w", "order_id", *keys).agg(*[F.sum(c).alias(c) for c in ("n", "q", "p", "f", "g")])


def sliding(events: DataFrame) -> DataFrame:
    """10-minute windows every 5 minutes per status. An event counts in two windows, so sums over
    windows are not totals."""
    return fold_parts(order_parts(events, SLIDE, ["order_status"]), ["order_status"])


def tumbling(events: DataFrame) -> DataFrame:
    """10-minute windows without overlap."""
    return fold_parts(order_parts(events, WINDOW, []), [])


def kpis(checked: DataFrame) -> DataFrame:
    """Counts and revenue of one batch: input, valid, quarantined, duplicates and headline figures."""
    ok = F.size(rules.IDS) == 0
    per_event = checked.groupBy(F.when(ok, F.col("event_id")).alias("_e"), ok.alias("_ok")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("event_timestamp", "value", "order_id", "quantity", "total_amount")).alias("least")
    )
    # One struct, so that the three belong to one copy: the least by time, then by text.
    per_event = per_event.select("_ok", "n", "least.*")
    good = F.col("_ok")
    per_order = per_event.groupBy(F.when(good, F.col("order_id")).alias("_o"), "_ok").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("events"), F.sum("quantity").alias("q"), F.sum("total_amount").alias("g")
    )

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(good, value)), F.lit(0))

    out = per_order.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_events"),
        total(F.col("events")).alias("valid_events"),
        F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)).alias("quarantined_events"),
        total(F.col("n") - F.col("events")).alias("duplicate_events"),
        total(F.col("g")).alias("_g"),
        F.count(F.when(good, 1)).alias("unique_orders"),
        total(F.col("q")).alias("units_sold"),
    )
    return out.select(
        "input_events",
        "valid_events",
        "quarantined_events",
        "duplicate_events",
        F.col("_g").cast("double").alias("gross_revenue"),
        "unique_orders",
        "units_sold",
        F.coalesce(mean_money(F.col("_g"), F.col("unique_orders")), F.lit(0.0)).alias("average_order_value"),
    )


# --- state across micro-batches -------------------------------------------------------------------

CHANGES = "ok boolean, event_id string, value string, sign int, seen bigint"
#: Parts that ids are dealt to. A call of Python takes all rows of a part, so calls do not grow with the ids.
STATE_PARTS = 1024
#: The time of an event without one: before all others, as NULL is the least value.
NO_TIME = -(1 << 63)


def _stored(held: dict[str, list]) -> bytes:
    """Held copies of a part as bytes: id, time, text, newest time and time of leaving of each."""
    return zlib.compress(json.dumps([[key, *copy] for key, copy in held.items()]).encode(), 1)


def _held(data: bytes) -> dict[str, list]:
    return {key: copy for key, *copy in json.loads(zlib.decompress(data))}


def changes(checked: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """What every micro-batch changes in the set of distinct valid events, as signed rows.

    Of the copies of an event the least one counts, by time, then by text, so any order of arrival leads to the
    same row. State holds that one copy per id and lets it go when the watermark has passed its copies by the delay. A
    better copy gives two rows: the one it replaces with sign -1, itself with +1. Copies that change nothing have sign
    0, rejected messages too; ``seen`` counts the messages behind a row. Sums of signed amounts over any batches are
    therefore those of the distinct events, without reading earlier batches. Copies later than the watermark are dropped
    by it, as by every operator with event time. Ids share the state of their part, which has the time-out of the
    first of them to leave.
    """
    span = int(pd.Timedelta(delay).total_seconds() * 1000)
    ok = F.size(rules.IDS) == 0
    rows = checked.withWatermark("event_timestamp", delay).select(
        ok.alias("ok"),
        F.when(ok, F.col("event_id")).alias("event_id"),
        "event_timestamp",
        F.coalesce(F.unix_micros("event_timestamp"), F.lit(NO_TIME)).alias("at"),
        "value",
        # Rejected messages have no common id; their own text spreads them over parts.
        F.pmod(F.xxhash64(F.when(ok, F.col("event_id")).otherwise(F.col("value"))), F.lit(STATE_PARTS)).alias("part"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = _held(state.get[0]) if state.exists else {}
        out: list[tuple] = []
        found: dict[str, list] = {}
        for frame in () if state.hasTimedOut else frames:
            for good, event, at, value in zip(frame["ok"], frame["event_id"], frame["at"].tolist(), frame["value"]):
                if not good:
                    out.append((False, None, value, 0, 1))
                    continue
                # The least copy of this batch, the newest time and the number of messages.
                copy = found.get(event)
                if copy is None:
                    found[event] = [at, value, max(0, at), 1]
                    continue
                if (at, value) < (copy[0], copy[1]):
                    copy[0], copy[1] = at, value
                copy[2], copy[3] = max(copy[2], at), copy[3] + 1
        for event, (at, value, last, seen) in found.items():
            before = held.get(event)
            if before is not None:
                last = max(last, before[2])
            better = before is None or (at, value) < (before[0], before[1])
            if better and before is not None:
                out.append((True, event, before[1], -1, 0))
            out.append((True, event, value if better else None, int(better), seen))
            best = (at, value) if better else before[:2]
            held[event] = [*best, last, max(last // 1000, now) + span + 1]
        held = {event: copy for event, copy in held.items() if event in found or copy[3] >= now}
        if held:
            state.update((_stored(held),))
            state.setTimeoutTimestamp(max(now + 1, min(copy[3] for copy in held.values())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["ok", "event_id", "value", "sign", "seen"])

    return rows.groupBy("part").applyInPandasWithState(step, CHANGES, "held binary", "update", GroupStateTimeout.EventTimeTimeout)


def signed_parts(events: DataFrame, groups: list[Column | str]) -> DataFrame:
    """Signed sums per group and order of parsed changes."""
    sign = F.col("sign")
    return events.groupBy(*groups, "order_id").agg(
        F.sum(sign).alias("n"),
        F.sum(sign * F.col("quantity")).alias("q"),
        *[F.sum(F.when(sign == -1, -F.col(c)).otherwise(F.col(c))).alias(a) for c, a in (("price", "p"), ("freight_value", "f"), ("total_amount", "g"))],
    )


def write_changes(root: str):
    """Batch handler for ``changes``: rejected messages, signed events, window parts and counts below the batch id."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        overwrite_batch(batch, f"{root}/changes", batch_id)
        stored = spark.read.schema(CHANGES).parquet(f"{root}/changes/batch_id={batch_id}")
        overwrite_batch(stored.filter(~F.col("ok")).select("value"), f"{root}/quarantine", batch_id)
        events = parse(stored.filter(F.col("sign") != 0), ("sign",))
        overwrite_batch(signed_parts(events, [F.window("event_timestamp", WINDOW, SLIDE).alias("w"), "order_status"]), f"{root}/sliding", batch_id)
        overwrite_batch(signed_parts(events, []), f"{root}/orders", batch_id)
        counts = stored.groupBy("ok").agg(F.sum("seen").alias("seen"), F.sum("sign").alias("events"))
        overwrite_batch(counts, f"{root}/counts", batch_id)

    return handle


def merged_sliding(parts: DataFrame) -> DataFrame:
    """Sliding windows over all batches from their signed parts; an order whose events all moved away is none."""
    keys = ["order_status"]
    return fold_parts(merge_parts(parts, keys).filter(F.col("n") > 0), keys)


def merged_kpis(orders: DataFrame, counts: DataFrame) -> DataFrame:
    """The figures of ``kpis`` over all batches, duplicates across batches included."""
    per = orders.groupBy("order_id").agg(*[F.sum(c).alias(c) for c in ("n", "q", "g")]).filter(F.col("n") > 0)
    both = counts.select("ok", "seen", "events").unionByName(per.select("n", "q", "g"), allowMissingColumns=True)
    total = lambda value: F.coalesce(F.sum(value), F.lit(0))
    ok, seen = F.col("ok"), F.col("seen")
    totals = both.agg(
        total(seen).alias("input_events"),
        total(F.when(ok, F.col("events"))).alias("valid_events"),
        total(F.when(~ok, seen)).alias("quarantined_events"),
        (total(F.when(ok, seen)) - total(F.when(ok, F.col("events")))).alias("duplicate_events"),
        total(F.col("g")).alias("_g"),
        F.count("n").alias("unique_orders"),
        total(F.col("q")).alias("units_sold"),
    )
    return totals.select(
        "input_events",
        "valid_events",
        "quarantined_events",
        "duplicate_events",
        F.col("_g").cast("double").alias("gross_revenue"),
        "unique_orders",
        "units_sold",
        F.coalesce(mean_money(F.col("_g"), F.col("unique_orders")), F.lit(0.0)).alias("average_order_value"),
    )


# --- sinks ----------------------------------------------------------------------------------------


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Process what is available into a Parquet sink; the checkpoint makes a restart add nothing twice."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(path)
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, handler, checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handler)
        .start()
    )
    query.awaitTermination()
    return query


def overwrite_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """Write one batch below its own id; a retried batch replaces itself and nothing else."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/batch_id={batch_id}")


def micro_batch(root: str):
    """Batch handler: silver, quarantine, window aggregates and a report, all keyed by the batch id.

    The flagged events are written once and read back, so the four outputs do not evaluate the
    source four times.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        overwrite_batch(check(parse(batch)), f"{root}/checked", batch_id)
        flagged = spark.read.parquet(f"{root}/checked/batch_id={batch_id}")
        silver = deduplicate(rules.valid(flagged))
        overwrite_batch(silver, f"{root}/silver", batch_id, ["order_year_month"])
        rejected = flagged.filter(F.size(rules.IDS) > 0).select(
            "value", F.array_join(rules.IDS, "; ").alias("rule_ids"), F.array_join(rules.REASONS, "; ").alias("reasons")
        )
        overwrite_batch(rejected, f"{root}/quarantine", batch_id)
        written = spark.read.parquet(f"{root}/silver/batch_id={batch_id}")
        overwrite_batch(sliding(written), f"{root}/gold", batch_id)
        overwrite_batch(kpis(flagged), f"{root}/report", batch_id)

    return handle


def route_late(root: str):
    """Batch handler that sends events older than the newest seen so far minus ten minutes to their
    own quarantine, and events without a time to another. The newest event time is kept per batch, so a
    retry compares with the same mark."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        overwrite_batch(batch, f"{root}/incoming", batch_id)
        events = spark.read.parquet(f"{root}/incoming/batch_id={batch_id}")
        mark = None
        if batch_id > 0:
            seen = spark.read.parquet(f"{root}/marks").filter(F.col("batch_id") < batch_id)
            mark = seen.agg(F.max("newest")).first()[0]
        late = F.lit(False) if mark is None else F.col("event_timestamp") < F.lit(mark) - F.expr(f"interval {LATE_SECONDS} seconds")
        dated = F.col("event_timestamp").isNotNull()
        overwrite_batch(events.filter(dated & ~late), f"{root}/on_time", batch_id)
        overwrite_batch(events.filter(dated & late), f"{root}/late", batch_id)
        overwrite_batch(events.filter(~dated), f"{root}/undated", batch_id)
        overwrite_batch(events.agg(F.max("event_timestamp").alias("newest")), f"{root}/marks", batch_id)

    return handle
