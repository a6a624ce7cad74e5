"""Hard-negative mining with Fagin's threshold algorithm.

Vectors become integers, floor(SCALE * x), and a score is an integer inner product. Anchors are a stated set of rows; an
anchor's positives are the first POSITIVES other rows of its label, and for each positive the first NEGATIVES rows
of other labels are wanted whose score lies in a window below the positive's: LOW to HIGH percent of it.

Anchors go against all rows in blocks. Rows are dealt into blocks of about BLOCK_ROWS by a hash, anchors into
groups of about GROUP_ANCHORS; a task gets one group and one block, so its memory is bounded whatever the table
or the labels look like, and a label with a third of all rows lies in all blocks alike. Within a block every dimension
has a list of its rows sorted by the component. An anchor reads the lists of all dimensions from the end
that its own component's sign favours, in steps that double the depth. Rows that come up are scored by random
access. The threshold, the anchor's product with the components at the depth reached, bounds the score of every
row not seen yet; a window is done when the threshold is strictly below its kth score (so ties are settled by id) or
below its low end, and the anchor stops when all its windows are done. Two rounds: positives over the lists of
their label, then, with the positives of all blocks merged, negatives of all positives of an anchor in one run.

Products are exact: they are taken in doubles when no sum can pass 2^53, else in whole numbers of any size.

Defined cases: rows with a NULL id, label or vector, or with a NULL or non-finite component take no part; vectors of
differing lengths are compared as if filled up with zeros; rows equal in id, label and vector are one row; equal scores
are ordered by id; an anchor without positives, or a positive without rows in its window, gives no rows; a score beyond
the range of a long fails with an error; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillflow.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Window of the negatives in percent of the positive's score, both ends included.
LOW, HIGH = 50, 95
#: Rows of a block and anchors of a group that a task gets; small tables have smaller ones, so that tasks are shared out.
BLOCK_ROWS, GROUP_ANCHORS = 65_536, 4_096
LEAST_ROWS, LEAST_ANCHORS = 4_096, 256
SHARES = 8
#: First depth as a part of the block; every step doubles it.
FIRST_DEPTH = 32
EXACT = 2**53


def whole(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer components as a matrix of doubles, filled up with zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; exact: doubles hold every sum."""
    if exact:
        return rows @ anchor
    a = [int(v) for v in anchor]
    return np.array([sum(x * int(y) for x, y in zip(a, row)) for row in rows] + [None], dtype=object)[:-1]


class Lists:
    """Rows of a block in one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        order = np.argsort(ids, kind="stable")  # so that of equal scores the smaller id stands first
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.up = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        #: Largest component of any anchor.
        self.largest = largest
        own = float(np.abs(self.vectors).max(initial=0))
        self.exact = own * largest * max(vectors.shape[1], 1) < EXACT

    def search(self, anchor: np.ndarray, done) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) seen in sorted access before done(scores, rows, threshold) holds.

        The threshold is None when no row is left to see.
        """
        n = len(self.ids)
        live = np.flatnonzero(anchor)
        forward, back = live[anchor[live] < 0], live[anchor[live] > 0]
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=float if self.exact else object)
        depth, step = 0, max(1, n // FIRST_DEPTH)
        while True:
            fresh = np.zeros(n, dtype=bool)
            upto = min(n, depth + step)
            fresh[self.up[depth:upto, forward]] = True
            fresh[self.up[n - upto : n - depth, back]] = True
            depth, step = upto, depth + step
            if not len(live):
                # A zero anchor favours no dimension: all rows have the score zero.
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            rows = np.concatenate((rows, new))
            scores = np.concatenate((scores, products(self.vectors[new], anchor, self.exact)))
            if len(rows) == n:
                done(rows, scores, None)
                return rows, scores
            border = np.zeros(len(anchor))
            border[forward] = self.vectors[self.up[depth - 1, forward], forward]
            border[back] = self.vectors[self.up[n - depth, back], back]
            if done(rows, scores, products(border[None, :], anchor, self.exact)[0]):
                return rows, scores


def best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher scores first, then smaller ids, which have smaller row numbers."""
    if len(scores) > 4 * k and scores.dtype != object:
        # All that could be among the first k, ties with the kth included.
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    order = sorted(some.tolist(), key=lambda i: (-scores[i], rows[i]))
    return np.array(order[:k], dtype=np.int64)


def _kth(scores: np.ndarray, k: int):
    """The kth best score; None with fewer."""
    if len(scores) < k:
        return None
    return sorted(scores, reverse=True)[k - 1] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]


def _width(*tables: pa.Table) -> int:
    return max([0, *[s for t in tables for s in t.column("vector").combine_chunks().value_lengths().to_pylist()]])


def _cell(rows: pa.Table, anchors: pa.Table) -> tuple:
    """Ids, labels and components of the rows, components and labels of the anchors."""
    width = _width(rows, anchors)
    vectors, own = whole(rows.column("vector"), width), whole(anchors.column("vector"), width)
    labels, own_labels = (np.array(t.column("label").to_pylist(), dtype=str) for t in (rows, anchors))
    return rows.column("id").to_numpy(), labels, vectors, own, own_labels


FOUND = "anchor long, id long, score long"


def _long(values) -> pa.Array:
    return pa.array([int(v) for v in values], pa.int64())


def nearest(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Of a block, the first POSITIVES rows of each anchor's label other than itself."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    found: list[tuple] = []
    if len(rows) and len(anchors):
        ids, labels, vectors, own, own_labels = _cell(rows, anchors)
        own_ids, numbers = anchors.column("id").to_numpy(), anchors.column("anchor").to_pylist()
        largest = float(np.abs(own).max(initial=0))
        for label in np.unique(own_labels):
            held = labels == label
            if not held.any():
                continue
            lists = Lists(ids[held], vectors[held], largest)
            for i in np.flatnonzero(own_labels == label).tolist():
                # One row more than wanted: the anchor itself may be among them.
                def done(_rows, scores, threshold):
                    kth = None if threshold is None else _kth(scores, POSITIVES + 1)
                    return kth is not None and threshold < kth

                at, scores = lists.search(own[i], done)
                other = (lists.ids[at] != own_ids[i]) | (lists.vectors[at] != own[i]).any(axis=1)
                at, scores = at[other], scores[other]
                found += [(numbers[i], int(lists.ids[at[j]]), scores[j]) for j in best(at, scores, POSITIVES)]
    columns = list(zip(*found)) or [()] * 3
    return pa.Table.from_arrays([_long(c) for c in columns], names=names)


NEGATIVE = "anchor long, nth int, id long, score long"


def windows(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Of a block, the first NEGATIVES rows of other labels in the window of each positive of each anchor."""
    found: list[tuple] = []
    if len(rows) and len(anchors):
        ids, labels, vectors, own, own_labels = _cell(rows, anchors)
        numbers, positives = anchors.column("anchor").to_pylist(), anchors.column("positives").to_pylist()
        lists = Lists(ids, vectors, float(np.abs(own).max(initial=0)))
        labels = labels[np.argsort(ids, kind="stable")]
        for i, number in enumerate(numbers):
            bounds = [(-(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in positives[i]]
            hit: list = []

            def done(at, scores, threshold, label=own_labels[i], bounds=bounds, hit=hit):
                other = labels[at] != label
                at, scores = at[other], scores[other]
                hit.clear()
                ended = True
                for low, high in bounds:
                    inside = np.flatnonzero((scores >= low) & (scores <= high))
                    hit.append((at[inside], scores[inside]))
                    if threshold is not None and ended and low <= high and threshold >= low:
                        kth = _kth(scores[inside], NEGATIVES)
                        ended = kth is not None and threshold < kth
                return ended

            lists.search(own[i], done)
            for nth, (at, scores) in enumerate(hit):
                found += [(number, nth, int(lists.ids[at[j]]), scores[j]) for j in best(at, scores, NEGATIVES)]
    columns = list(zip(*found)) or [()] * 4
    return pa.Table.from_arrays([_long(columns[0]), pa.array(columns[1], pa.int32()), _long(columns[2]), _long(columns[3])], names=[c.split()[0] for c in NEGATIVE.split(", ")])


def _spread(n: int, most: int, least: int) -> int:
    """Number of parts of n rows: of `most` rows at most, SHARES parts if they then have `least` rows."""
    return max(-(-n // most), min(SHARES, n // least), 1)


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    anchors: condition that makes a row an anchor.
    """
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole_rows = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite
    fields = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")]
    # Repeats are combined before the shuffle, so a row that is a third of the table is one row per task.
    rows = vectors.where(whole_rows).select(*fields, F.coalesce(anchors, F.lit(False)).alias("starts"))
    rows = materialize(rows.groupBy("id", "label", "vector").agg(F.max("starts").alias("starts")), "negatives-rows")
    # Numbered, since an id may stand for several vectors.
    starts = rows.where("starts").withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("label", "vector")))
    starts = materialize(starts.select(F.xxhash64("id", "nth").alias("anchor"), "id", "label", "vector"), "negatives-anchors")
    blocks, groups = _spread(rows.count(), BLOCK_ROWS, LEAST_ROWS), _spread(starts.count(), GROUP_ANCHORS, LEAST_ANCHORS)
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    dealt = rows.drop("starts").withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))).withColumn("group", every(groups))

    def against(frame: DataFrame, fn, schema: str) -> DataFrame:
        asked = frame.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups))).withColumn("block", every(blocks))
        cells = dealt.groupBy("block", "group")
        return cells.cogroup(asked.groupBy("block", "group")).applyInArrow(fn, schema)

    order = [F.col("score").desc(), F.col("id")]
    first = against(starts, nearest, FOUND).withColumn("r", F.row_number().over(W.partitionBy("anchor").orderBy(*order))).where(F.col("r") <= POSITIVES)
    listed = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("positives"))
    ready = materialize(starts.join(listed, "anchor"), "negatives-positives")
    second = against(ready, windows, NEGATIVE).withColumn("r", F.row_number().over(W.partitionBy("anchor", "nth").orderBy(*order))).where(F.col("r") <= NEGATIVES)
    named = ready.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("nth", "p"))
    return named.join(second, ["anchor", "nth"]).select(
        "anchor_id",
        F.col("p.id").alias("positive_id"),
        F.col("r").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
