"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Every record is hashed by its text into one of thousands of slots, so equal texts share a slot. Bytes and
rows are summed per slot; a slot that holds more than an eighth of a shard's share (one text may fill a
third of the table) is cut into parts by the hash of the id. The cells (slot, part) are dealt to shards
largest first, always to the shard with the fewest bytes. The map is a small table with a bounded number
of rows: the slots and at most twice eight parts for every shard. It is stored with a version; rebalancing
edits it and moves no other cell. All steps are DataFrame and SQL expressions.

Defined cases: a NULL text has no bytes and counts its eight bytes of frame; NULL ids hash alike and come
first in their cell; repeated rows take different positions; an empty table gives an empty result and an
empty map; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillflow.session import materialize

SLOTS = 4096
#: A slot above the n-th part of a shard's share of bytes or rows is cut.
FINENESS = 8
FRAME_BYTES = 8


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Compact row per document: id, size, crc, virtual slot. The only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(FRAME_BYTES)).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).cast("long").alias("crc"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("vslot"),
    )


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int").alias("part")


def slot_parts(rows: DataFrame, shards: int) -> DataFrame:
    """One row per slot: into how many parts it is cut."""
    per_slot = rows.groupBy("vslot").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    everything = W.partitionBy()
    share = lambda c: F.col(c) * (shards * FINENESS) / F.sum(c).over(everything)
    return per_slot.select("vslot", F.greatest(F.lit(1), F.ceil(F.greatest(share("bytes"), share("rows")))).cast("long").alias("parts"))


def deal(cells: DataFrame, shards: int, start: DataFrame | None = None) -> DataFrame:
    """Shard of every cell: largest first, to the shard with the fewest bytes so far.

    cells: vslot, part, bytes, rows, one row per cell of the bounded map. start: one row, `loads`.
    """
    listed = cells.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("weight"), "vslot", "part", "bytes", "rows"))).alias("cells"))
    listed = listed.crossJoin(start) if start is not None else listed.withColumn("loads", F.array_repeat(F.lit(0).cast("long"), shards))

    def place(acc: Column, cell: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1
        loads = F.transform(acc["loads"], lambda v, k: F.when(k == at, v + cell["bytes"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc["out"], F.array(at.cast("int"))).alias("out"))

    first = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("out"))
    dealt = listed.select("cells", F.aggregate("cells", first, place)["out"].alias("out"))
    return dealt.select(F.inline(F.arrays_zip("cells", "out"))).select("cells.vslot", "cells.part", F.col("out").alias("shard"), "cells.bytes", "cells.rows")


def slot_map(rows: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: version, vslot, parts, part, shard, bytes, rows."""
    parts = slot_parts(rows, shards)
    cut = rows.join(F.broadcast(parts), "vslot")  # at most one row per slot
    cells = cut.groupBy("vslot", "parts", _part(F.col("parts"))).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return deal(cells, shards).join(F.broadcast(parts), "vslot").select(F.lit(1).alias("version"), "vslot", "parts", "part", "shard", "bytes", "rows")


def rebalance(current: DataFrame, shards: int) -> DataFrame:
    """Next version of a map for another number of shards or other bytes per cell.

    Cells of shards that are gone, and the smallest cells of a shard above its share, are dealt anew;
    every other cell stays where it is.
    """
    share = F.sum("bytes").over(W.partitionBy()) / shards
    running = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot", "part"))
    marked = current.select("*", ((F.col("shard") < shards) & ((running <= share) | (running == F.col("bytes")))).alias("stays"))
    stay = marked.where("stays")
    loads = stay.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    loads = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("held")).select(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0)).cast("long")).alias("loads")
    )
    moved = deal(marked.where("NOT stays"), shards, loads)
    after = stay.select("vslot", "part", "shard", "bytes", "rows").unionByName(moved)
    info = current.select("vslot", "part", "parts", (F.col("version") + 1).alias("version"))
    return after.join(info, ["vslot", "part"]).select("version", "vslot", "parts", "part", "shard", "bytes", "rows")


def place(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of `keyed` with their shard and a gapless position in it.

    A cell starts where the cells before it in its shard end; only rows of one cell are ordered together.
    """
    before = W.partitionBy("shard").orderBy("vslot", "part").rowsBetween(W.unboundedPreceding, -1)
    placed = table.select("vslot", "parts", "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    slots = table.select("vslot", "parts").distinct()
    cut = rows.join(F.broadcast(slots), "vslot").select("id", "bytes", "crc", "vslot", _part(F.col("parts")))
    inside = F.row_number().over(W.partitionBy("vslot", "part").orderBy("id", "crc", "bytes"))
    cut = cut.withColumn("nth", inside)
    return cut.join(F.broadcast(placed.drop("parts")), ["vslot", "part"]).select(
        "id", "bytes", "crc", "vslot", "part", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("position")
    )


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed rows, stored map)."""
    rows = materialize(keyed(docs, id_col, text_col, slots), "shard-keys")
    table = materialize(slot_map(rows, shards), "shard-map")
    return place(rows, table), table
