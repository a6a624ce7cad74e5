"""Exact deduplication against immutable snapshots screened by static binary-fuse filters.

Every text is reduced to its SHA-256 once. A snapshot keeps one row per digest in hash buckets and,
for every bucket, a static filter of about nine bits a digest. Digests of a new batch are grouped
among themselves first, so a text that fills a third of the batch is one row; each bucket of them is
then screened by the filter of the same bucket. Only positives are joined with the exact bucket, and
groups that hold more than one row are compared byte by byte by grouping on the text itself.
A bucket has a bounded number of digests, as the number of buckets follows their count.

Defined cases: NULL text equals the empty text. An empty table gives an empty result. Of rows with equal
text the largest id stays; NULL ids are smaller than all others. Rows that repeat both id and text tie:
exactly one of them stays. Other columns, also ones named like those made here, play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.session import materialize

#: Digests that a bucket holds on average, which bounds the memory of one filter build.
BUCKET_DIGESTS = 100_000
#: Attempts to build one filter; each fails with a chance of a few percent at most.
SEEDS = 64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _slots(h: np.ndarray, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three cells of consecutive segments for each hash."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(starts * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Static filter of distinct 64-bit keys: (seed, segment length, start segments, cells).

    Keys are peeled in rounds: all keys that alone use some cell leave together, and cells are filled
    in the reverse order, so that the three cells of every key combine to its fingerprint.
    """
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = max(len(keys), 1)
    segment = 1 << int(np.clip(np.floor(np.log(n) / np.log(3.33) + 2.25), 2, 18))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    starts = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(SEEDS):
        cells = np.zeros((starts + 2) * segment, dtype=np.uint8)
        if not len(keys):
            return seed, segment, starts, cells
        h = _mixed(keys, seed)
        slots = np.stack(_slots(h, segment, starts))
        counts = np.bincount(slots.ravel(), minlength=len(cells))
        owners = np.zeros(len(cells), dtype=np.int64)  # sum of the keys still using the cell
        for row in slots:
            np.add.at(owners, row, np.arange(len(keys)))
        order, left = [], len(keys)
        single = np.flatnonzero(counts == 1)
        while len(single):
            peeled, where = np.unique(owners[single], return_index=True)
            order.append((peeled, single[where]))
            left -= len(peeled)
            touched = slots[:, peeled]
            np.subtract.at(counts, touched.ravel(), 1)
            np.subtract.at(owners, touched.ravel(), np.tile(peeled, 3))
            touched = np.unique(touched)
            single = touched[counts[touched] == 1]
        if left:
            starts += 1 if seed % 4 == 3 else 0
            continue
        prints = _prints(h)
        for peeled, at in reversed(order):
            cells[at] = 0
            a, b, c = slots[:, peeled]
            cells[at] = prints[peeled] ^ cells[a] ^ cells[b] ^ cells[c]
        return seed, segment, starts, cells
    raise ValueError("no seed builds the filter")


def screen(keys: np.ndarray, seed: int, segment: int, starts: int, cells: np.ndarray) -> np.ndarray:
    """True for every key of the filter and for about one in 256 others."""
    h = _mixed(np.asarray(keys, dtype=np.uint64), seed)
    a, b, c = _slots(h, segment, starts)
    return (cells[a] ^ cells[b] ^ cells[c]) == _prints(h)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8")


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row; the only pass over all texts."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def classes_of(keys: DataFrame) -> DataFrame:
    """One row per digest: largest id, rows, and rows that carry that id."""
    per_id = keys.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("id", "n"))
    return per_id.groupBy("digest").agg(largest["id"].alias("keep"), largest["n"].alias("same"), F.sum("n").alias("rows"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


class Snapshot:
    """Immutable classes in buckets, each with its static filter; both are written tables."""

    def __init__(self, classes: DataFrame):
        spark = classes.sparkSession
        classes = materialize(classes, "dedup-classes")
        self.buckets = max(1, -(-classes.count() // BUCKET_DIGESTS))
        self.classes = classes.withColumn("bucket", _bucket(self.buckets))
        self.filters = materialize(
            self.classes.select("bucket", "digest").groupBy("bucket").applyInPandas(_filter_of, "bucket int, seed int, segment int, starts int, cells binary"), "dedup-filters"
        )
        self.spark = spark

    def positives(self, classes: DataFrame) -> DataFrame:
        """Rows of new classes that the filters let through: all known digests and few others."""
        new = classes.withColumn("bucket", _bucket(self.buckets))
        kept = new.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(_let_through, "digest binary, keep long, same long, rows long")
        return kept


def _filter_of(part: pd.DataFrame) -> pd.DataFrame:
    seed, segment, starts, cells = build_filter(_keys(part["digest"]))
    return pd.DataFrame({"bucket": [int(part["bucket"].iloc[0])], "seed": [seed], "segment": [segment], "starts": [starts], "cells": [cells.tobytes()]})


def _let_through(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    columns = ["digest", "keep", "same", "rows"]
    if not len(known) or not len(new):
        return new[columns].iloc[:0]
    f = known.iloc[0]
    hit = screen(_keys(new["digest"]), int(f["seed"]), int(f["segment"]), int(f["starts"]), np.frombuffer(f["cells"], dtype=np.uint8))
    return new[columns][hit]


def duplicate_classes(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of two or more rows, their bytes compared: (digest, keep, same, rows).

    Rows with an even hash of the id form the snapshot, the others the batch that comes in.
    """
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    snapshot = Snapshot(classes_of(keys.where(even)))
    batch = materialize(classes_of(keys.where(~even)), "dedup-batch")
    passed = materialize(snapshot.positives(batch), "dedup-positives")
    known = snapshot.classes.drop("bucket")
    met = known.join(passed.select("digest"), "digest", "left_semi").unionByName(passed.join(known.select("digest"), "digest", "left_semi"))
    groups = met.unionByName(known.where("rows > 1")).unionByName(batch.where("rows > 1")).select("digest").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256))).join(groups, "digest", "left_semi")
    # Grouping on the text is the comparison of bytes; equal rows are combined before the shuffle.
    same = texts.groupBy("digest", "text", "id").agg(F.count(F.lit(1)).alias("n"))
    same = same.groupBy("digest", "text").agg(F.max(F.struct("id", "n")).alias("m"), F.sum("n").alias("rows"))
    checked = same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.first("m").alias("m"), F.first("rows").alias("rows"))
    clash = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share one SHA-256"))).otherwise(F.col("rows"))
    return checked.select("digest", F.col("m.id").alias("keep"), F.col("m.n").alias("same"), clash.cast("long").alias("rows"))


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = materialize(digests_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "dedup-keys")
    groups = materialize(duplicate_classes(docs, keys.drop("row"), id_col, text_col), "dedup-groups")
    # Only rows that tie on text and largest id need a choice among rows.
    tied = groups.where("same > 1").select("digest", "keep")
    chosen = keys.join(tied, (keys.digest == tied.digest) & keys.id.eqNullSafe(tied.keep), "left_semi").groupBy("digest").agg(F.min("row").alias("row_kept"))
    return (
        keys.join(groups, "digest", "left")
        .join(chosen, "digest", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
            F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("rows").isNull(), F.lit(True)).when(F.col("row_kept").isNotNull(), F.col("row") == F.col("row_kept")).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that repeat a text; all columns stay as they are."""
    keys = materialize(digests_of(docs, id_col, text_col), "dedup-keys")
    groups = materialize(duplicate_classes(docs, keys, id_col, text_col), "dedup-groups")
    gone = keys.join(groups, "digest").where(~F.col("id").eqNullSafe(F.col("keep"))).select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    marked = docs.withColumns({"__key": F.col(id_col).cast("long"), "__sha": F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))})
    left = marked.join(gone, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest")), "left_anti")
    if not groups.where("same > 1").isEmpty():
        left = left.dropDuplicates(["__key", "__sha"])
    return left.drop("__key", "__sha")
