"""SimHash near-deduplication with pigeonring filtering.

A fingerprint has 64 bits. Two fingerprints link if they differ in two bits or fewer. The 64 bits are a ring
of three segments; by the pigeonring principle some chain that starts at a segment i keeps within its
proportional budget at every length: no difference in segment i, one at most in segments i and i + 1
together, two in all. One difference leaves one half of segment i + 1 alone, so candidates share segment
i and a half of the next: 31 or 32 bits under six keys. Candidates are tested for the chain, then for all bits.

Equal fingerprints are one node. A key with more than HOT nodes is not paired: each of its nodes names all
fingerprints within one bit of itself, and nodes that name the same one link. That finds the same links
through their common neighbour in 65 rows a node, whatever the size of the key, and nothing is dropped.

Defined cases: NULL and blank texts have fingerprint zero and link like others; texts of fewer words than a
shingle have one shingle of all their words; very long texts are read whole; NULL ids are passed over when the
smallest id of a component is chosen; repeated rows get the same answer, and where copies are dropped one row
of them stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tillflow.session import materialize

from .components import roots

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Segments of the ring as (first bit, bits), least significant bit first.
RING = ((0, 22), (22, 21), (43, 21))
#: Nodes of one key that are paired within a row.
HOT = 24


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, most significant first."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    tails = ends[shingle - 1 :] or ends[-1:]
    hashes = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts, tails)])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
    counts = bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(bits)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, extra: str | None = None) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. extra: a string column to carry along."""
    carried = [extra] if extra else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = b"".join([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()])
            fps = pa.array(np.frombuffer(prints, dtype=">i8").astype("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps, *[batch.column(c) for c in carried]], ["doc_id", "fp", *carried])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carried)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{c} string" for c in carried]]))


def _mask(first: int, bits: int) -> int:
    value = ((1 << bits) - 1) << first
    return value - (1 << 64) if value >> 63 else value


def keys(nodes: DataFrame) -> DataFrame:
    """Six keys per node: (kind, value, next, fp); next is the mask of the second segment of the chain."""
    fp = F.col("fp")
    kinds = []
    for i, segment in enumerate(RING):
        first, bits = RING[(i + 1) % len(RING)]
        for start, count in ((first, bits // 2), (first + bits // 2, bits - bits // 2)):
            mask = _mask(*segment) | _mask(start, count)
            kinds.append(F.struct(F.lit(len(kinds)).alias("kind"), fp.bitwiseAND(F.lit(mask)).alias("value"), F.lit(_mask(first, bits)).alias("next")))
    return nodes.select("fp", F.explode(F.array(*kinds)).alias("k")).select("k.kind", "k.value", "k.next", "fp")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): linked distinct fingerprints, complete up to the links that others imply."""
    keyed = materialize(keys(nodes), "simhash-keys")
    sizes = keyed.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["kind", "value"])
    groups = sized.where(F.col("n") <= HOT).groupBy("kind", "value", "next").agg(F.collect_list("fp").alias("fps"))
    pairs = F.expr(
        f"""filter(flatten(transform(fps, (a, i) -> transform(slice(fps, i + 2, size(fps)), b -> struct(a, b)))),
            p -> bit_count((p.a ^ p.b) & next) <= {DISTANCE - 1} AND bit_count(p.a ^ p.b) <= {DISTANCE})"""
    )
    near = groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    # The exact way for hot keys: at most 65 nodes lie within one bit of any fingerprint.
    hot = sized.where(F.col("n") > HOT).select("fp").distinct()
    around = hot.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("z"))
    around = around.groupBy("z").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    through = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return near.unionByName(through)


def rooted(prints: DataFrame) -> DataFrame:
    """One row per distinct fingerprint: fp, smallest id that has it, root of its component."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    linked = roots(links(nodes)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id (smallest id reachable)."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    nodes = rooted(prints)
    least = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = nodes.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of every component, that of the smallest id; all columns stay as they are.

    NULL ids are larger than all others. Rows that share the smallest id are told apart by the MD5 of their text,
    and of rows equal in both any one stays.
    """
    key, sha = F.col(id_col).cast("long"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    marked = docs.withColumns({"__key": key, "__sha": sha})
    prints = materialize(fingerprints(marked, id_col, text_col, extra="__sha"), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__sha"))
    # Rows of one fingerprint, a third of all maybe, are one row before the join.
    per_print = prints.groupBy("fp").agg(first.alias("k"))
    kept = per_print.join(rooted(prints).select("fp", "root"), "fp").groupBy("root").agg(F.min("k").alias("k"))
    kept = materialize(kept.select(F.col("k.doc_id").alias("__id"), F.col("k.__sha").alias("__digest")), "simhash-kept")
    left = marked.join(kept, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest")), "left_semi")
    tied = prints.groupBy("doc_id", "__sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not tied.isEmpty():
        left = left.dropDuplicates(["__key", "__sha"])
    return left.drop("__key", "__sha")
