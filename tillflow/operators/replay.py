"""Replay of rows that depend on those before them, cut into blocks of time that run apart.

A limiter or a counter is sequential per key, so one busy key would be one task. Here the time of a key is cut into
blocks. Every block is played from an empty state first; then blocks whose state from the block before differs from
the one they were played with are played again, until no state changes. Limiters forget within a window or so, which
is why a block many windows long mostly ends in the same state whatever it started with, and the second round settles
all. Where states still differ after ROUNDS rounds, the rest of that key, from its first unsettled block on, is played
in sequence by one task. The result is exact in every case.

Tasks stream Arrow batches and hold one state. A block begins with a row that carries its state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ROUNDS = 4
STATE = "array<bigint>"

#: Results of consecutive rows at times in microseconds, in order; the first list is the state and is changed in place.
Step = Callable[[list[int], list[int]], list]


def block_of(t: Column, length: int) -> Column:
    """Number of the block a moment lies in, exact for all whole numbers."""
    return F.call_function("div", t - F.pmod(t, F.lit(length)), F.lit(length))


def _laid(rows: DataFrame, states: DataFrame, order: list[str]) -> DataFrame:
    """Rows behind the head of their block, every block in one task and in order; states are JSON."""
    both = rows.withColumn("_state", F.lit(None).cast(STATE)).unionByName(states.select("_who", "_block", "_state"), allowMissingColumns=True)
    laid = both.repartition("_who", "_block").sortWithinPartitions("_who", "_block", F.col("_state").isNull(), "_t", *order)
    # As text: a column of arrays makes up most of the time in which rows go to Python.
    return laid.withColumn("_state", F.to_json("_state"))


def _cutter() -> Callable[[pa.RecordBatch], Iterator[tuple[int | None, list[int]]]]:
    """A function that cuts a batch into its blocks: (place of the head, times), in order; rows that go on with the
    block before have no head. It is made here so that tasks get it with what they run."""

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[int]]]:
        heads = np.flatnonzero(batch.column("_state").is_valid().to_numpy(zero_copy_only=False)).tolist()
        for head, end in zip([None, *heads], [*heads, batch.num_rows]):
            start = 0 if head is None else head + 1
            if head is not None or end:
                yield head, batch.column("_t").slice(start, end - start).to_pylist()

    return cut


def _ends(rows: DataFrame, states: DataFrame, order: list[str], step: Step) -> DataFrame:
    """State of every block in ``states`` after its last row."""
    columns = ["_who", "_block", "_t", "_state"]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64())]
    cut = _cutter()

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for head, times in cut(batch):
                if head is not None:
                    if current:
                        done.append(current)
                    who, block, state = (batch.column(c)[head].as_py() for c in columns if c != "_t")
                    current = (who, block, json.loads(state))
                step(current[2], times)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)], ["_who", "_block", "_end"])
        if current:
            yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(current, kinds)], ["_who", "_block", "_end"])

    slim = rows.select("_who", "_block", "_t", *order)
    laid = _laid(slim, states, order).select(*columns)
    return laid.mapInArrow(play, f"_who string, _block bigint, _end {STATE}")


def replay(rows: DataFrame, order: list[str], length: int, step: Step, live: Callable[[Column, Column], Column], name: str, kind: str) -> DataFrame:
    """``rows`` with the result of ``step`` as ``name`` (of SQL type ``kind``: boolean or bigint).

    ``rows`` has ``_who`` (text, the key) and ``_t`` (microseconds) and is stored, as every round reads it. ``length`` is that of a block in microseconds. ``live`` cuts a state to what can matter at or after a
    moment; a state must be empty once a whole block without rows has passed.
    """
    rows = rows.withColumn("_block", block_of(F.col("_t"), length))
    empty = F.array().cast(STATE)
    states = materialize(rows.select("_who", "_block").distinct().withColumn("_state", empty), "replay-states")
    # Only the end of a block with a next one matters.
    ahead = states.select("_who", (F.col("_block") - 1).alias("_block"))
    leading = states.join(ahead, ["_who", "_block"], "left_semi")

    def played(part: DataFrame) -> DataFrame:
        return _ends(rows.join(part.select("_who", "_block"), ["_who", "_block"], "left_semi"), part, order, step)

    ends = materialize(played(leading), "replay-ends")
    for nth in range(ROUNDS + 1):
        before = ends.select("_who", (F.col("_block") + 1).alias("_block"), "_end")
        start = F.col("_block") * F.lit(length)
        came = F.coalesce(live(F.col("_end"), start), empty)
        states = states.join(before, ["_who", "_block"], "left").select("_who", "_block", came.alias("_state"), (came != F.col("_state")).alias("_changed"))
        states = materialize(states, "replay-states")
        changed = states.filter("_changed")
        if changed.isEmpty():
            break
        if nth == ROUNDS:
            first = changed.groupBy("_who").agg(F.min("_block").alias("_first"))
            rows = rows.join(first, "_who", "left").withColumn("_block", F.least("_block", "_first")).drop("_first")
            states = states.join(first, "_who", "left").filter("_first IS NULL OR _block <= _first").drop("_first")
            break
        again = changed.join(ahead, ["_who", "_block"], "left_semi")
        ends = materialize(ends.join(changed, ["_who", "_block"], "left_anti").unionByName(played(again)), "replay-ends")

    kept = [f for f in rows.schema.fields if f.name not in ("_who", "_block", "_t")]
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64()}[kind]

    cut = _cutter()

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[int] = []
        for batch in batches:
            got = []
            for head, times in cut(batch):
                if head is not None:
                    state = json.loads(batch.column("_state")[head].as_py())
                    got.append(None)
                got.extend(step(state, times))
            columns = [batch.column(f.name) for f in kept] + [pa.array(got, arrow)]
            out = pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + [name])
            yield out.filter(pc.is_null(batch.column("_state")))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` {kind}"
    return _laid(rows, states, order).mapInArrow(results, schema)
