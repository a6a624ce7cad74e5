"""Substring deduplication with fixed-block anchors.

A repeat is a window of WINDOW consecutive words. Reference texts are cut into non-overlapping blocks of
BLOCK words; as WINDOW = 2 x BLOCK - 1, every window of a reference holds exactly one whole block, so a text
that repeats a window also has that block at one of BLOCK places. The blocks are the index; every rolling
run of BLOCK words of every text probes it. Windows around a hit are then compared as a whole, and the
words of all windows that hold are joined, which extends every hit to its maximal exact repeat.

Texts are dealt into chunks by a hash of the row. A chunk sends its distinct probes, hashed and packed, to hash
buckets; a bucket answers with one bit per probe, so an answer costs no more than the question, and no pair
of texts is ever formed: a passage in a third of all documents is one entry per chunk. The windows around
hits go the same way with 64-bit hashes beside the bucket's bits and the smallest document id of the chunk.
The texts are shuffled once; the passes over them reuse that exchange. Numbers of chunks and buckets follow
the bytes of the table, so memory per task stays bounded.

Defined cases: NULL and blank texts have no words and keep the hash of the empty text; texts shorter than a
window lose nothing; NULL ids count as the largest long; rows that share an id do not take words from each
other; very long texts are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Bytes of text per chunk and per bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Word hashes of the texts of a chunk, in the order of ids."""

    def __init__(self, docs: pd.DataFrame):
        ids, unnamed = docs["doc_id"].to_numpy(dtype=np.int64), docs["unnamed"].to_numpy(dtype=bool)
        order = np.lexsort((docs["text"].fillna("").to_numpy(dtype=object), ids, unnamed))
        self.unnamed, self.ids = unnamed[order], ids[order]
        self.texts = [(t or "").encode() for t in docs["text"].where(docs["text"].notna(), "").iloc[order]]
        data = np.frombuffer(b"\n".join(self.texts) + b"\n", dtype=np.uint8)
        space = _SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1]
        starts = np.flatnonzero(begins)
        sizes = np.fromiter(map(len, self.texts), dtype=np.int64, count=len(self.texts)) + 1
        self.doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
        self.counts = np.bincount(self.doc, minlength=len(self.texts))
        value = np.where(space, np.uint64(0), _BYTE[data]) * _powers(_STEP, len(data))
        sums = np.add.reduceat(value, starts) if len(starts) else np.zeros(0, np.uint64)
        self.hashes = _mixed(sums * _powers(_BACK, len(data))[starts])
        ends = np.cumsum(self.counts)
        self.nth = np.arange(len(starts)) - (ends - self.counts)[self.doc]
        self.left = ends[self.doc] - np.arange(len(starts))

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of `size` words inside one text."""
        n = max(len(self.hashes) - size + 1, 0)
        value = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            value = value * _STEP + self.hashes[k : k + n]
        at = np.flatnonzero(self.left[:n] >= size)
        return at, _mixed(value[at])


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which general compression shortens."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


class Probes:
    """Distinct probes of a chunk by bucket: every run of BLOCK words, 30 bits of hash beside the bucket."""

    def __init__(self, words: Words, buckets: int):
        self.at, value = words.runs(BLOCK)
        key = (value >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | value & np.uint64(0x3FFFFFFF)
        self.keys, self.inverse = np.unique(key, return_inverse=True)
        self.aligned = np.bincount(self.inverse, weights=words.nth[self.at] % BLOCK == 0, minlength=len(self.keys)) > 0
        doc = words.doc[self.at]
        lowest = np.full(len(self.keys), len(words.ids))
        highest = np.full(len(self.keys), -1)
        np.minimum.at(lowest, self.inverse, doc)
        np.maximum.at(highest, self.inverse, doc)
        self.shared = lowest < highest
        self.buckets = (self.keys >> np.uint64(32)).astype(np.int64)


class Candidates:
    """Distinct windows around hits of a chunk by bucket, with the first text of each."""

    def __init__(self, words: Words, hit: np.ndarray, buckets: int):
        at, value = words.runs(WINDOW)
        near = np.concatenate(([0], np.cumsum(hit)))
        held = near[np.minimum(at + BLOCK, len(hit))] > near[at]
        self.at, value = at[held], value[held]
        # The bucket comes from a second mixing, so it adds to the 64 bits of the key.
        bucket = (_mixed(value + _STEP) >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((self.at, value, bucket))
        b, v = bucket[order], value[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
        self.inverse = np.empty(len(order), dtype=np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.keys, self.buckets = v[new], b[new].astype(np.int64)
        self.first = words.ids[words.doc[self.at[order[new]]]]


def _slices(buckets: np.ndarray):
    """(bucket, first, end) of runs of equal buckets."""
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    bounds = [0, *cuts.tolist(), len(buckets)]
    return [(int(buckets[a]), a, b) for a, b in zip(bounds, bounds[1:]) if b > a]


def _answer(masks: pd.DataFrame, kind: int, own: Probes | Candidates) -> np.ndarray:
    """Bits of a chunk's questions in their order."""
    out = np.zeros(len(own.keys), dtype=bool)
    rows = masks[masks["kind"] == kind]
    bits = dict(zip(rows["bucket"], rows["bits"]))
    for bucket, a, b in _slices(own.buckets):
        if bucket in bits:
            out[a:b] = np.unpackbits(np.frombuffer(bits[bucket], dtype=np.uint8), count=b - a)
    return out


def _hits(words: Words, probes: Probes, masks: pd.DataFrame) -> np.ndarray:
    hit = np.zeros(len(words.hashes), dtype=bool)
    hit[probes.at] = _answer(masks, 0, probes)[probes.inverse]
    return hit


ASKED = "bucket long, chunk long, keys binary, marks binary"
ANSWERED = "chunk long, bucket long, kind int, bits binary"


def _ask(buckets: int):
    def run(docs: pd.DataFrame) -> pd.DataFrame:
        probes = Probes(Words(docs), buckets)
        chunk = int(docs["chunk"].iloc[0])
        low = (probes.keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows = [
            (bucket, chunk, _planes(np.diff(low[a:b], prepend=np.uint32(0))), np.packbits(np.concatenate((probes.aligned[a:b], probes.shared[a:b]))).tobytes())
            for bucket, a, b in _slices(probes.buckets)
        ]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "marks"])

    return run


def _match(asked: pd.DataFrame) -> pd.DataFrame:
    """A probe hits if a block has its hash and more than one text asks for it."""
    parts = [np.cumsum(_from_planes(k, "<u4"), dtype=np.uint32) for k in asked["keys"]]
    sizes = np.array([len(p) for p in parts])
    marks = [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=2 * n).reshape(2, n) for m, n in zip(asked["marks"], sizes)]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    aligned = np.bincount(group, weights=np.concatenate([m[0] for m in marks])[order]) > 0
    texts = np.bincount(group, weights=1.0 + np.concatenate([m[1] for m in marks])[order]) > 1
    hit = np.empty(len(keys), dtype=bool)
    hit[order] = (aligned & texts)[group]
    return _bits(asked, sizes, hit, 0)


def _bits(asked: pd.DataFrame, sizes: np.ndarray, hit: np.ndarray, kind: int) -> pd.DataFrame:
    ends = np.cumsum(sizes)
    rows = [(c, b, kind, np.packbits(hit[e - n : e]).tobytes()) for c, b, e, n in zip(asked["chunk"], asked["bucket"], ends, sizes) if hit[e - n : e].any()]
    return pd.DataFrame(rows, columns=["chunk", "bucket", "kind", "bits"])


def _extend(buckets: int):
    def run(docs: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "chunk", "keys", "marks"]
        if not len(docs) or not len(masks):
            return pd.DataFrame([], columns=columns)
        words = Words(docs)
        found = Candidates(words, _hits(words, Probes(words, buckets), masks), buckets)
        chunk = int(docs["chunk"].iloc[0])
        rows = [(bucket, chunk, _planes(found.keys[a:b].astype("<u8")), _planes(found.first[a:b].astype("<i8"))) for bucket, a, b in _slices(found.buckets)]
        return pd.DataFrame(rows, columns=columns)

    return run


def _compare(asked: pd.DataFrame) -> pd.DataFrame:
    """True where a window's smallest document is not in the asking chunk."""
    parts = [_from_planes(k, "<u8") for k in asked["keys"]]
    sizes = np.array([len(p) for p in parts])
    keys, first = np.concatenate(parts), np.concatenate([_from_planes(m, "<i8") for m in asked["marks"]])
    order = np.lexsort((first, keys))
    ranked = keys[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    least = first[order][new][np.cumsum(new) - 1]
    earlier = np.empty(len(keys), dtype=bool)
    earlier[order] = least < first[order]
    return _bits(asked, sizes, earlier, 1)


RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def _remove(buckets: int, with_text: bool):
    def run(docs: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]
        if not len(docs):
            return pd.DataFrame([], columns=columns)
        words = Words(docs)
        gone = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        if len(masks):
            found = Candidates(words, _hits(words, Probes(words, buckets), masks), buckets)
            earlier = _answer(masks, 1, found)[found.inverse] | (words.ids[words.doc[found.at]] > found.first[found.inverse])
            np.add.at(gone, found.at[earlier], 1)
            np.subtract.at(gone, found.at[earlier] + WINDOW, 1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.bincount(words.doc, weights=gone, minlength=len(words.texts)).astype(np.int64)
        rows, at = [], 0
        for given, text, n, lost in zip(words.ids.tolist(), words.texts, words.counts.tolist(), removed.tolist()):
            kept = text.split()
            if lost:
                kept = [w for w, g in zip(kept, gone[at : at + n].tolist()) if not g]
            at += n
            joined = b" ".join(kept)
            rows.append((given, n, lost, joined.decode() if with_text else None, sha256(joined).hexdigest()))
        out = pd.DataFrame(rows, columns=columns)
        out["doc_id"] = pd.arrays.IntegerArray(words.ids.copy(), words.unnamed.copy())
        return out

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (NULL unless wanted), kept_sha256."""
    # A NULL in a pandas group would turn all its ids into floats, so it is a flag beside a number.
    named = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(named, F.lit(NO_ID)).alias("doc_id"), named.isNull().alias("unnamed"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = 1 + size // CHUNK_BYTES, 1 + size // BUCKET_BYTES
    texts = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    asked = texts.groupBy("chunk").applyInPandas(_ask(buckets), ASKED)
    hits = asked.groupBy("bucket").applyInPandas(_match, ANSWERED)
    windows = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInPandas(_extend(buckets), ASKED)
    answers = hits.unionByName(windows.groupBy("bucket").applyInPandas(_compare, ANSWERED))
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_remove(buckets, with_text), RESULT)
