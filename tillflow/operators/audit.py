"""Log analytics: search, summaries, hash chains, bursts, rate limits and lockouts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .fill import fill_directional
from .neighbors import with_neighbor
from .replay import block_of, replay

MICROS = 1_000_000
GENESIS = "0" * 64
#: Windows of one block of a replay.
BLOCK = 256


def search(log: DataFrame, filters: dict[str, object], newest: list[Column], limit: int) -> DataFrame:
    """Newest rows that match all given filters."""
    for column, value in filters.items():
        if value is not None:
            log = log.filter(F.col(column) == value)
    return log.orderBy(*newest).limit(limit)


def summary(log: DataFrame, severities: list[str], categories: dict[str, list[str]], latest: int | None = None, newest: list[Column] | None = None) -> DataFrame:
    """Counts per severity and per category of event types, over all rows or the latest ``n``."""
    rows = log.orderBy(*newest).limit(latest) if latest else log
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(f"severity_{s.lower()}") for s in severities]
    counts += [F.count(F.when(F.col("event_type").isin(types), 1)).alias(name) for name, types in categories.items()]
    return rows.agg(F.count(F.lit(1)).alias("total_events"), *counts)


def micros(c: str) -> Column:
    return F.unix_micros(c)


def trailing_count(df: DataFrame, keys: list[str], moment: str, seconds: int, name: str = "trailing_count") -> DataFrame:
    """Rows of the same key in the ``seconds`` up to and including each row (older edge excluded).

    A key is cut into buckets as long as the window. Every row also visits the next bucket as
    history, so each bucket is complete on its own and a hot key spreads over its buckets. History
    is there from the start and leaves after the window, so one running sum counts a bucket, however
    many rows a window holds. Rows of unknown time count themselves and their history.
    """
    width = seconds * MICROS
    t = micros(moment)
    bucket = F.floor(t / width)
    own = F.struct(bucket.alias("b"), t.alias("at"), F.lit(1).alias("step"))
    left = F.struct((bucket + 1).alias("b"), (t + F.lit(width)).alias("at"), F.lit(-1).alias("step"))
    wide = df.withColumn("_visit", F.explode(F.array(own, left))).withColumns({"_b": F.col("_visit.b"), "_at": F.col("_visit.at"), "_step": F.col("_visit.step")})
    inside = W.partitionBy(*keys, "_b").orderBy("_at")
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    history, unknown = F.count(F.when(F.col("_step") < 0, 1)).over(whole), F.count(F.lit(1)).over(whole)
    here = F.sum("_step").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    counted = wide.withColumn(name, F.when(F.col("_at").isNull(), unknown).otherwise(history + here))
    return counted.filter("_step > 0").drop("_visit", "_b", "_at", "_step")


def bursts(df: DataFrame, keys: list[str], moment: str, seconds: int, threshold: int) -> DataFrame:
    counted = trailing_count(df, keys, moment, seconds)
    return counted.withColumn("breached", F.col("trailing_count") >= threshold)


def segments(df: DataFrame, keys: list[str], moment: str, tie: str, seconds: int) -> DataFrame:
    """Start of the run of rows with gaps below the window: after a longer pause a limiter is empty,
    so runs are independent of each other and can be replayed apart."""
    day = F.to_date(moment)
    seen = with_neighbor(df, keys, [moment, tie], day, {"_before": moment})
    fresh = F.col("_before").isNull() | (micros(moment) - micros("_before") > seconds * MICROS)
    marked = seen.withColumn("segment", F.when(fresh, F.col(moment))).drop("_before")
    return fill_directional(marked, keys, [moment, tie], "segment", day)


def _named(df: DataFrame, keys: list[str], moment: str) -> DataFrame:
    """With the key as one text, in which NULL is a value like others, and the time in microseconds."""
    who = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return df.withColumns({"_who": who, "_t": micros(moment)})


def rate_limit(df: DataFrame, keys: list[str], moment: str, tie: str, limit: int, seconds: int, block: int = BLOCK) -> DataFrame:
    """Replay of a sliding-window limiter in which only accepted requests count.

    A request whose trailing count of all requests is within the limit is accepted whatever came before, without
    leaving the JVM. The others depend on the window before them: the buckets of one window's length that hold them,
    and the bucket before each, are replayed in blocks of ``block`` windows (see ``replay``), so even a key that never
    pauses spreads over its blocks. ``moment`` must be known; ``tie`` orders equal times.
    """
    window = seconds * MICROS
    counted = trailing_count(df, keys, moment, seconds, "_trailing")
    rows = _named(counted, keys, moment).withColumn("_sure", F.col("_trailing") <= limit).drop("_trailing")
    rows = materialize(rows.withColumn("_bucket", block_of(F.col("_t"), window)), "limit-rows")
    near = F.explode(F.array(F.col("_bucket"), F.col("_bucket") - 1)).alias("_bucket")
    busy = materialize(rows.filter(~F.col("_sure")).select("_who", near).distinct(), "limit-busy")
    calm = rows.join(busy, ["_who", "_bucket"], "left_anti").select(*df.columns, F.lit(True).alias("allowed"))
    if busy.isEmpty():
        return calm
    work = materialize(rows.join(busy, ["_who", "_bucket"], "left_semi").drop("_bucket", "_sure"), "limit-work")

    def step(accepted: list[int], times: list[int]) -> list[bool]:
        allowed, i = [False] * len(times), 0
        while i < len(times):
            while accepted and accepted[0] <= times[i] - window:
                accepted.pop(0)
            if len(accepted) < limit:
                accepted.append(times[i])
                allowed[i] = True
                i += 1
            else:
                # Nothing is accepted until the oldest one leaves.
                i = bisect_left(times, accepted[0] + window, i)
        return allowed

    def live(state: Column, start: Column) -> Column:
        return F.filter(state, lambda x: x > start - window)

    played = replay(work, [tie], block * window, step, live, "allowed", "boolean")
    return calm.unionByName(played)


def lockouts(df: DataFrame, keys: list[str], moment: str, tie: str, limit: int, seconds: int, block: int = BLOCK) -> DataFrame:
    """Failed attempts per account: the count restarts when the first failure is older than the
    window; from the limit on, the account is locked for one window.

    After a pause longer than the window the counter is surely empty. Runs between such pauses that last no longer
    than the window are numbered on the JVM; only longer runs, in which the count restarts on the way, are replayed.
    """
    window = seconds * MICROS
    runs = materialize(segments(_named(df, keys, moment), ["_who"], moment, tie, seconds), "lockout-runs")
    spans = runs.groupBy("_who", "segment").agg((F.max("_t") - F.min("_t") > window).alias("_busy"))
    marked = runs.join(spans, ["_who", "segment"])
    place = F.row_number().over(W.partitionBy("_who", "segment").orderBy("_t", tie)).cast("bigint")
    calm = marked.filter(~F.col("_busy")).select(*df.columns, "_t", place.alias("failed_count"))
    work = marked.filter("_busy").select("_who", *df.columns, "_t", F.col("_t").alias("_at"))
    work = materialize(work, "lockout-work")

    def step(state: list[int], times: list[int]) -> list[int]:
        counts, i = [], 0
        while i < len(times):
            if not state or times[i] - state[0] > window:
                state[:] = [times[i], 0]
            # The count runs up to the last failure within the window of the first.
            end = bisect_right(times, state[0] + window, i)
            counts.extend(range(state[1] + 1, state[1] + 1 + end - i))
            state[1], i = state[1] + end - i, end
        return counts

    def live(state: Column, start: Column) -> Column:
        return F.when(F.get(state, F.lit(0)) >= start - window, state)

    if not work.isEmpty():
        played = replay(work, [tie], block * window, step, live, "failed_count", "bigint")
        calm = calm.unionByName(played.withColumnRenamed("_at", "_t"))
    until = F.when(F.col("failed_count") >= limit, F.timestamp_micros(F.col("_t") + window))
    return calm.withColumn("locked_until", until).drop("_t")


def content(columns: list[str]) -> Column:
    """Canonical JSON of a record: fixed key order, NULLs kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def _ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)


def chain_log(log: DataFrame, chain: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Append previous and own hash to every record of each chain, as a log writer would.

    A chain is sequential by nature; the writer streams through it and remembers one hash.
    """
    body = log.withColumn("body", content(columns))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, previous, position = None, GENESIS, 0
        for pdf in batches:
            before, own, positions = [], [], []
            for key, text in zip(pdf[chain].itertuples(index=False, name=None), pdf["body"]):
                if key != current:
                    current, previous, position = key, GENESIS, 0
                before.append(previous)
                previous = hashlib.sha256(f"{text}:{previous}".encode()).hexdigest()
                own.append(previous)
                positions.append(position)
                position += 1
            yield pdf.assign(previous_hash=before, event_hash=own, position=positions)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields) + ", previous_hash string, event_hash string, position bigint"
    return _ordered(body, chain, order).mapInPandas(write, schema)


def verify_chain(log: DataFrame, chain: list[str], columns: list[str]) -> DataFrame:
    """Per chain: records, validity and the first broken position.

    The content check is row by row. The link check meets each record with its predecessor through
    an equi-join on (chain, position - 1), which spreads even a single long chain over all tasks.
    """
    computed = F.sha2(F.concat(content(columns), F.lit(":"), F.col("previous_hash")), 256)
    rows = log.withColumn("_content_ok", computed == F.col("event_hash"))
    before = log.select(*chain, (F.col("position") + 1).alias("position"), F.col("event_hash").alias("_expected"))
    linked = rows.join(before, [*chain, "position"], "left")
    expected = F.when(F.col("position") == 0, F.lit(GENESIS)).otherwise(F.col("_expected"))
    link_ok = F.coalesce(F.col("previous_hash") == expected, F.lit(False))
    broken = F.when(~(link_ok & F.coalesce(F.col("_content_ok"), F.lit(False))), F.col("position"))
    return linked.groupBy(*chain).agg(F.count(F.lit(1)).alias("records"), F.min(broken).alias("first_broken")).withColumn(
        "valid", F.col("first_broken").isNull()
    )


def retain(log: DataFrame, day: str, newest: Column, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days; on a date-partitioned log this prunes partitions."""
    return log.filter(F.col(day) >= F.date_sub(newest, days))
