"""Token ids of all documents in order, written as Simple-8b blocks and read back.

Documents are range-partitioned by id, encoded in their partition and written as one file per partition;
Spark's writer commits whole tasks, so a lost executor leaves no torn file. A row of a file is a block
of consecutive documents: their ids, ids per document, the number of each document's first word, and the
64-bit words themselves. Any document of a block can be decoded from its own words, and a whole block with a
few array operations.

Encoding asks the tokenizer library for every distinct unit (a space or line feed and the characters up to
the next one, between which no token can lie) once per batch and remembers units per worker process. Signs at the end of a
word are tokens of their own, so a word is asked for once with and without them. Texts
with other white space, repeated spaces or line feeds, or special tokens go to the library whole.

Defined cases: a NULL or empty text has the end id alone; NULL ids come first; rows that repeat an id follow
each other in the order of a hash of their text; very long texts are encoded whole and may fill a block
alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillflow.session import shared_dir

from .simple8b import pack, unpack
from .words import grouped

BLOCK_IDS = 1 << 17
#: Units that a worker process remembers from batch to batch, those it keeps beyond that, and units in one call of the library.
MEMO_UNITS, KEPT_UNITS = 900_000, 300_000
TOGETHER = 200
#: White space other than the space and the line feed.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Signs that are cut from the end of a unit, at most TAIL of them, where they follow a letter below LATIN_END.
SIGNS, TAIL, LATIN_END = '.,;:!?#*$%&|<>()"-', 3, "\u0250"
BLOCKS = "part int, block int, n_ids long, n_docs int, doc_ids array<long>, counts binary, offsets binary, words binary"


class UnitTokenizer:
    """The library's encoding of whole texts, with a memo of units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        # A token of a byte-level vocabulary is written with one character per byte.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[str]) -> Iterator[bytes]:
        """Ids of units that each start with a space or a line feed, encoded side by side.

        No token crosses from one unit into the next, so bytes of units and of tokens tell where each ends.
        """
        for lo in range(0, len(units), TOGETHER):
            group = units[lo : lo + TOGETHER]
            ids = np.array(self.library.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(u.encode()) for u in group])) + 1
            data, at = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                yield data[at:end]
                at = end

    def units_of(self, text: str) -> list[str] | None:
        """Units without their leading space; None if the text has other white space, repeats or special tokens."""
        spread = text.replace("\n", " \n")
        if not text or "\n \n" in spread or "  " in spread or spread[0] == " " or spread[-1] in " \n" or any(c in text for c in OTHER_SPACE) or any(x in text for x in self.special):
            return None
        return spread.split(" ")

    def learned(self, new: set[str]) -> dict[str, bytes]:
        """Ids of units that the memo lacks, and of stems met on the way.

        No token holds both a letter and a sign of SIGNS behind it, so a unit that ends in such signs has the ids of its
        stem, often known already, and then theirs.
        """
        stems = {}
        for u in new:
            stem = u.rstrip(SIGNS)
            if stem and 0 < len(u) - len(stem) <= TAIL and stem[-1] < LATIN_END and stem[-1].isalpha():
                stems[u] = stem
        asked = list({x for u in new if (x := stems.get(u, u)) not in self.memo})
        found = dict(zip(asked, self.units([u if u[:1] == "\n" else " " + u for u in asked])))
        for u, stem in stems.items():
            tail = u[len(stem) :]
            if tail not in self.tails:
                self.tails[tail] = self.whole([tail])[0]
            found[u] = (found.get(stem) or self.memo[stem]) + self.tails[tail]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.units_of(t) for t in texts]
        # The first unit of a text has no space before it; it is known by the form after a line feed.
        for units in cut:
            if units is not None:
                units[0] = "\n" + units[0]
        # One look into the memo per unit; the places of unknown units are filled in afterwards.
        get = self.memo.get
        found = [None if units is None else list(map(get, units)) for units in cut]
        gaps = [[] if ids is None or None not in ids else [i for i, x in enumerate(ids) if x is None] for ids in found]
        learned = self.learned({units[i] for units, places in zip(cut, gaps) for i in places})
        for units, ids, places in zip(cut, found, gaps):
            for i in places:
                ids[i] = learned[units[i]]
        if len(self.memo) > MEMO_UNITS:
            # Those met first are the frequent ones for the most part.
            self.memo = dict(islice(self.memo.items(), KEPT_UNITS))
        self.memo.update(learned)
        rest = iter(self.whole([t for t, u in zip(texts, cut) if u is None]))
        return [next(rest) if ids is None else b"".join(ids)[4:] for ids in found]


_tokenizers: dict[str, UnitTokenizer] = {}


def tokenizer_at(path: str) -> UnitTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = UnitTokenizer(path)
    return _tokenizers[path]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the blocks of all documents in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        context = TaskContext.get()
        part, block = context.partitionId() if context else 0, 0
        for batch in batches:
            encoded = [e + end for group in grouped([t or "" for t in batch.column("text").to_pylist()]) for e in tokenizer.encode(group)]
            ids = batch.column("doc_id").to_pylist()
            lengths = np.array([len(e) // 4 for e in encoded], dtype=np.int64)
            first = 0
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(np.cumsum(lengths[first:]), block_ids, side="right")) + first)
                words, counts = pack(np.frombuffer(b"".join(encoded[first:last]), dtype="<u4"), lengths[first:last])
                row = {
                    "part": [part],
                    "block": [block],
                    "n_ids": [int(lengths[first:last].sum())],
                    "n_docs": [last - first],
                    "doc_ids": [ids[first:last]],
                    "counts": [lengths[first:last].astype("<u4").tobytes()],
                    "offsets": [(np.cumsum(counts) - counts).astype("<u4").tobytes()],
                    "words": [words.astype("<u8").tobytes()],
                }
                yield pa.RecordBatch.from_pydict(row, schema=_ARROW)
                first, block = last, block + 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ranged.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("offsets", pa.binary()), ("words", pa.binary())]
)


def decode_block(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids) of one block."""
    return row["doc_ids"], np.frombuffer(row["counts"], dtype="<u4").astype(np.int64), unpack(np.frombuffer(row["words"], dtype="<u8"))


def decode_document(row: dict, nth: int) -> np.ndarray:
    """Ids of one document of a block, from its own words."""
    words, offsets = np.frombuffer(row["words"], dtype="<u8"), np.frombuffer(row["offsets"], dtype="<u4")
    return unpack(words[offsets[nth] : offsets[nth + 1] if nth + 1 < len(offsets) else len(words)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    A block starts where the blocks before it end: parts are summed over parts, blocks within their part.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, counts, ids = decode_block(row)
                data, at = ids.astype("<u4").tobytes(), np.cumsum(counts) - counts
                crcs = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), counts.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = blocks.mapInArrow(run, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(W.orderBy("part")).alias("part_start"))
    inside = blocks.select("part", "block", before(W.partitionBy("part").orderBy("block")).alias("block_start"))
    starts = inside.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = shared_dir(docs.sparkSession, "token-files")
    write(docs, tokenizer_path, end_id, path, id_col, text_col)
    return read(docs.sparkSession, path)
