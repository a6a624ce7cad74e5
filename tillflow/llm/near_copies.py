"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are cut and lowered as in `simhash`; a shingle is five words, and a text of fewer words has one shingle of
all of them. Texts whose 64-bit fingerprints over these shingles differ in two bits or fewer are candidates by the ring of
`simhash.links`. At a similarity of 0.8 fingerprints differ in about ten bits, too many for segments of so short a ring,
so the pairs beyond come from minimum hashes: BANDS keys of WIDTH minimum hashes each. A pair of similarity s misses all
keys with probability (1 - s^WIDTH)^BANDS: below 3e-9 at 0.8, less above. Every candidate of either kind is then decided
by its exact similarity, so no pair below 0.8 links; what fingerprints linked is not paired again in keys of many nodes.

Texts of equal shingle sets are one node. Nodes of a key of HOT nodes or fewer are all paired. In a larger key,
for ROUNDS rounds one node is compared with all that it is not yet connected to, which connects a group of copies
in rows proportional to its size. What is then left unconnected in such keys is paired by prefix filtering over its
shingles, rarest first, which is exact. Only pairs that are connected already, whose sizes rule 0.8 out or that
share no rare shingle are left out.

Defined cases: NULL and blank texts are equal to each other and like no other text; very long texts are read
whole; NULL ids are larger than all others; repeated rows are one text, of which one row stays; an empty
table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from tillflow.session import materialize

from . import simhash
from .components import roots

SHINGLE = 5
#: Least similarity as a fraction: 4 of 5.
ALIKE, OF = 4, 5
BANDS, WIDTH = 50, 5
#: Nodes of one key that are all paired; rounds of one node against all for larger keys.
HOT, ROUNDS = 6, 3
#: Bits of a shingle's hash: sets of n shingles have unlike ones with equal hashes with a probability of n^2 / 2^48.
BITS = 48
#: Shingles whose hashes are held at a time.
GROUP = 4096

_random = np.random.default_rng(42)
_FACTORS = _random.integers(1 << 32, size=BANDS * WIDTH, dtype=np.uint32) | np.uint32(1)
_TERMS = _random.integers(1 << 32, size=BANDS * WIDTH, dtype=np.uint32)
_MIX = _random.integers(1 << 63, size=(BANDS, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(1 << 63, size=BANDS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    tails = ends[SHINGLE - 1 :] or ends[-1:]
    return np.unique(np.array([xxh64_intdigest(joined[a:b]) for a, b in zip(starts, tails)], dtype=np.uint64) >> np.uint64(64 - BITS))


def packed(hashes: np.ndarray) -> bytes:
    """Hashes in BITS bits each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // BITS, 8), dtype=np.uint8)
    out[:, : BITS // 8] = np.frombuffer(data, dtype=np.uint8).reshape(-1, BITS // 8)
    return out.view("<u8").ravel()


def keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles."""
    least = np.full(BANDS * WIDTH, 0xFFFFFFFF, dtype=np.uint32)
    short = (hashes >> np.uint64(BITS - 32)).astype(np.uint32)
    for at in range(0, len(short), GROUP):
        np.minimum(least, (_FACTORS[:, None] * short[None, at : at + GROUP] + _TERMS[:, None]).min(axis=1), out=least)
    key = (least.reshape(BANDS, WIDTH).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND
    key ^= key >> np.uint64(29)
    return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def alike(a: bytes, b: bytes) -> bool:
    """Whether two sets of shingles, sorted, are similar enough."""
    x, y = unpacked(a), unpacked(b)
    if not len(x) or not len(y):
        return len(x) == len(y)
    short, long = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    both = int((long[at] == short).sum())
    return OF * both >= ALIKE * (len(x) + len(y) - both)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sets = [shingles(t) for t in texts]
        held = [packed(s) for s in sets]
        bits = b"".join([simhash.fingerprint(t, SHINGLE) for t in texts])
        columns = [
            batch.column("doc_id"),
            batch.column("sha"),
            pa.array([xxh128_digest(s) for s in held], pa.binary()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([keys(s) for s in sets], pa.list_(pa.int64())),
            pa.array(held, pa.binary()),
            pa.array(np.frombuffer(bits, dtype=">i8").astype("<i8")),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "fp", "size", "keys", "set", "bits"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        yield batch.select(["a", "b"]).filter(pa.array([alike(x, y) for x, y in zip(left, right)], pa.bool_()))


def _sized(a: Column, b: Column) -> Column:
    """Sizes that allow the similarity."""
    return OF * F.least(a, b) >= ALIKE * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are similar enough; sets: node and set, one row per node."""
    named = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = named.join(sets.select(F.col("node").alias("a"), F.col("set").alias("left")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("right")), "b").select("a", "b", "left", "right")
    return both.mapInArrow(_alike, "a long, b long")


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with the component of each, only of keys that hold more than one; edges: from each node to its root."""
    linked = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    named = members.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named, "near-labels")
    mixed = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
    return named.join(mixed, "key")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a node."""
    for batch in batches:
        for i, held in enumerate(batch.column("set").to_pylist()):
            hashes = pa.array(unpacked(held).astype(np.int64))
            same = [pa.array(np.repeat(batch.column(c)[i].as_py(), len(hashes)), pa.int64()) for c in ("node", "size", "label")]
            yield pa.RecordBatch.from_arrays([*same, hashes], ["node", "size", "label", "shingle"])


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal or linked, each with the least node of its own and of a linked one.

    Numbers of nodes are compared through one node per fingerprint, so copies make rows in proportion to their number.
    """
    least = materialize(nodes.groupBy("bits").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "near-bits")
    equal = nodes.join(least.where("n > 1"), "bits").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(least.select(F.col("bits").alias("fp"))).distinct()
    near = near.join(least.select(F.col("bits").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("bits").alias("b"), F.col("least").alias("y")), "b")
    return equal.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def prefixed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes of differing labels that may be similar enough, by prefix filtering.

    Similar sets share ALIKE / OF of the larger one at least, so with all shingles in one order, rarest first, each has a
    shared one among its first size - ALIKE * size / OF + 1. Texts that have a passage in common but rare shingles of
    their own thus never meet. Of the shingles that a pair shares only the first must leave room for enough others behind
    it on both sides, so a pair makes rows only where it does. Nodes of a shingle's most frequent label are not paired
    among each other.
    """
    spelled = members.join(sets, "node").select("node", "size", "label", "set").mapInArrow(_spelled, "node long, size long, label long, shingle long")
    spelled = materialize(spelled, "near-shingles")
    counts = spelled.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rarest = W.partitionBy("node").orderBy("n", "shingle")
    first = F.col("size") - F.floor((ALIKE * F.col("size") + OF - 1) / OF) + 1
    firsts = spelled.join(counts, "shingle").withColumn("r", F.row_number().over(rarest)).where((F.col("r") <= first) & (F.col("n") > 1))
    firsts = materialize(firsts.select("shingle", "node", "size", "label", "r"), "near-firsts")
    per = firsts.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    mixed = firsts.join(most, "shingle")
    x, y = mixed.where(F.col("label") != F.col("most.label")).alias("x"), mixed.alias("y")
    room = 1 + F.least(F.col("x.size") - F.col("x.r"), F.col("y.size") - F.col("y.r"))
    enough = (ALIKE + OF) * room >= ALIKE * (F.col("x.size") + F.col("y.size"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & _sized(F.col("x.size"), F.col("y.size")) & enough)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def linked(nodes: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b): the root b of every node a that is not one. nodes: node, fp, size, keys, bits; prints: fp and set, any rows."""
    close = materialize(by_fingerprint(nodes.select("node", "bits")), "near-close")
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keyed.join(counts, "key"), "near-keys")
    met = shared.select("node").unionByName(close.select(F.col("a").alias("node"))).unionByName(close.select(F.col("b").alias("node")))
    named = nodes.select("node", "fp").join(met.distinct(), "node")
    held = prints.join(named, "fp").groupBy("fp").agg(F.first("node").alias("node"), F.first("set").alias("set"))
    sets = materialize(held.select("node", "set"), "near-sets")
    groups = shared.where(F.col("n") <= HOT).groupBy("key").agg(F.collect_list(F.struct("node", "size")).alias("m"))
    pairs = F.expr(
        f"""filter(flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.node AS a, y.node AS b, x.size AS s, y.size AS t)))),
            p -> {OF} * least(p.s, p.t) >= {ALIKE} * greatest(p.s, p.t))"""
    )
    edges = roots(confirmed(groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b").unionByName(close), sets))
    members = shared.where(F.col("n") > HOT).select("key", "node", "size")
    if members.isEmpty():
        return edges
    for nth in range(ROUNDS + 1):
        members = materialize(_labelled(members, edges), "near-members")
        if members.isEmpty():
            break
        if nth < ROUNDS:
            # The same order in every key, so that keys of one group of copies agree on the node.
            drawn = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(nth)), "node", "size", "label")).alias("c"))
            near = members.join(drawn, "key").where((F.col("label") != F.col("c.label")) & _sized(F.col("size"), F.col("c.size")))
            near = near.select(F.col("c.node").alias("a"), F.col("node").alias("b"))
        else:
            near = prefixed(members.select("node", "size", "label").distinct(), sets)
        edges = roots(edges.unionByName(confirmed(near, sets)))
        members = members.drop("label")
    return edges


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of every component of similar texts, that of the smallest id.

    Rows that share the smallest id are told apart by the MD5 of their text, and of rows equal in both any one stays.
    """
    key, sha = F.col(id_col).cast("long"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    marked = docs.withColumns({"__key": key, "__sha": sha})
    rows = marked.select(F.col("__key").alias("doc_id"), F.col("__sha").alias("sha"), F.col(text_col).alias("text"))
    prints = materialize(rows.mapInArrow(_prints, "doc_id long, sha string, fp binary, size long, keys array<long>, set binary, bits long"), "near-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")).alias("k")
    # Numbers are stored with the nodes: half the bytes of a fingerprint in every row of keys, pairs and labels.
    nodes = prints.groupBy("fp").agg(first, F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    rooted = linked(nodes.select("node", "fp", "size", "keys", "bits"), prints.select("fp", "set")).select(F.col("a").alias("node"), F.col("b").alias("root"))
    kept = nodes.select("node", "k").join(rooted, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    kept = materialize(kept.select(F.col("k.doc_id").alias("__id"), F.col("k.sha").alias("__digest")), "near-kept")
    left = marked.join(kept, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest")), "left_semi")
    tied = prints.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not tied.isEmpty():
        left = left.dropDuplicates(["__key", "__sha"])
    return left.drop("__key", "__sha")
