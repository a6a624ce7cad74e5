"""SentencePiece BPE encoding by prefix table, and decoding.

A text is cut where no piece of the model can cross: before a run of spaces, and around line feeds (no
piece holds a space mark after another character, or a line feed; both are checked when a model is loaded).
A unit is encoded by a table that stores, for every prefix, the one token with which the encoding of that
prefix ends. Candidates are the pieces that an Aho-Corasick automaton finds ending there; a candidate fits
if it starts the unit or if the last token of the prefix before it and the candidate stay as they are when
their strings are encoded side by side. Ids are recovered backwards from the end.

Whether a pair stays is decided by merging its characters once and remembered per worker process, as are
encoded units; both are cut down at a fixed number of entries, which affects speed alone, so a worker's memory
does not grow with the texts it has seen. The units of a group of texts that are new are encoded together:
position by position, all candidates of all units at once.

Defined cases: NULL and the empty text have no ids and decode to the empty text. Characters without a piece
become byte pieces. Very long texts are encoded whole; a single unit of any length needs memory in
proportion to it. Repeated rows and ties give the same ids each time. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import grouped

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
#: Units that a worker process remembers from group to group, about 300 bytes each, and those it keeps beyond that.
MEMO_UNITS, KEPT_UNITS = 200_000, 100_000
#: Pairs of tokens that it remembers, 16 to 32 bytes each.
MEMO_PAIRS = 1_000_000
#: Units that are encoded together; longer ones than LONG go one by one.
TOGETHER = 40_000
#: Rows of a batch that are made strings at a time, and characters of text that are cut into units at a time.
GROUP_ROWS, GROUP_CHARS = 1_000, 1_000_000
LONG = 64
START, BYTES, UNKNOWN = -1, -2, -3


class PairMemo:
    """Yes or no by a key from 0 to 2^60; a slot is zero or holds the key plus one and the answer in its last bit."""

    MIX = 0x1E3779B97F4A7C15

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self._use(1 << 16)
        self.count = 0

    def _use(self, size: int) -> None:
        self.slots = np.zeros(size, dtype=np.int64)
        self.view = memoryview(self.slots)
        self.mask = size - 1

    def place(self, key: int) -> int:
        """The slot that holds the key, or the free one where it belongs."""
        at = ((key * self.MIX) >> 32) & self.mask
        while (held := self.view[at]) and held >> 1 != key + 1:
            at = (at + 1) & self.mask
        return at

    def places(self, keys: np.ndarray) -> np.ndarray:
        """`place` of many keys."""
        at = ((keys * self.MIX) >> 32) & self.mask
        held = self.slots[at]
        todo = np.flatnonzero((held != 0) & (held >> 1 != keys + 1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.slots[at[todo]]
            todo = todo[(held != 0) & (held >> 1 != keys[todo] + 1)]
        return at

    def add(self, at: int, key: int, yes: bool) -> None:
        """Put an answer into the key's own place."""
        self.view[at] = 2 * (key + 1) + yes
        self.count += 1
        if 2 * self.count > len(self.slots):
            held = self.slots[self.slots != 0]
            self._use(2 * len(self.slots))
            while len(held):
                places = self.places((held >> 1) - 1)
                self.slots[places] = held
                held = held[self.slots[places] != held]


class PieceModel:
    """Pieces of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.byte_of[i] = value
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.rank[piece] = model.get_score(i)
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError("a piece crosses a unit border")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.size = [len(p) for p in self.pieces]
        self.id_text = [str(i) for i in range(len(self.pieces))]
        self.piece_bytes = [p.replace(MARK, " ").encode() for p in self.pieces]
        self.width = 1 << (len(self.pieces) - 1).bit_length()
        self.pairs = PairMemo()
        self.units: dict[str, tuple[int, str, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """Merge characters by the best score, leftmost first: the definition of the encoding."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """True if the two tokens stay apart and whole side by side; left START: begin of the unit."""
        key = (left + 1) * self.width + right
        at = self.pairs.place(key)
        held = self.pairs.view[at]
        if held:
            return bool(held & 1)
        a, b = "" if left < 0 else self.pieces[left], self.pieces[right]
        stays = self.merged(a + b) == ([a, b] if a else [b])
        self.pairs.add(at, key, stays)
        return stays

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`fits` of many pairs."""
        key = (left + 1) * self.width + right
        held = self.pairs.slots[self.pairs.places(key)]
        new = held == 0
        if new.any():
            for k in np.unique(key[new]).tolist():
                self.fits(k // self.width - 1, k % self.width)
            held[new] = self.pairs.slots[self.pairs.places(key[new])]
        return (held & 1) != 0

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit: the prefix table, then the way back."""
        last = [START] + [UNKNOWN] * len(unit)
        done = 0
        for end, token in self.automaton.iter(unit):
            for done in range(done + 1, end + 1):
                if last[done] == UNKNOWN:
                    last[done] = BYTES
            done = end
            if last[end + 1] == UNKNOWN:
                # Bytes never merge, so what follows them starts afresh.
                left = max(last[end + 1 - self.size[token]], START)
                if self.fits(left, token):
                    last[end + 1] = token
        ids: list[int] = []
        at = len(unit)
        while at > 0:
            token = last[at]
            if token < 0:
                ids.extend(self.bytes[b] for b in reversed(unit[at - 1].encode()))
                at -= 1
            else:
                ids.append(token)
                at -= self.size[token]
        ids.reverse()
        return ids

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of many units: every step handles the same position of all of them."""
        joined = "\n".join(units) + "\n"
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), dtype=np.int64).reshape(-1, 2)
        end, token = found[:, 0], found[:, 1]
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        nth = end - starts[np.searchsorted(starts, end, side="right") - 1]
        order = np.argsort(nth, kind="stable")
        levels = np.concatenate(([0], np.cumsum(np.bincount(nth, minlength=int(sizes.max(initial=0)) + 1))))
        # last[i] belongs to the prefix that ends before character i; separators start their unit.
        last = np.full(len(joined) + 1, BYTES, dtype=np.int64)
        last[starts[:-1]] = START
        for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist()):
            at, tokens = end[order[lo:hi]], token[order[lo:hi]]
            ok = self.fit(np.maximum(last[at + 1 - self.lengths[tokens]], START), tokens)
            last[at[ok] + 1] = tokens[ok]
        ids: list[list[int]] = [[] for _ in units]
        which, at = np.arange(len(units)), starts[:-1] + sizes
        live = sizes > 0
        which, at = which[live], at[live]
        while len(which):
            tokens = last[at]
            for u, i, t in zip(which.tolist(), at.tolist(), tokens.tolist()):
                if t >= 0:
                    ids[u].append(t)
                else:
                    ids[u].extend(self.bytes[b] for b in reversed(joined[i - 1].encode()))
            at = at - np.where(tokens >= 0, self.lengths[np.maximum(tokens, 0)], 1)
            live = at > starts[which]
            which, at = which[live], at[live]
        for found_ids in ids:
            found_ids.reverse()
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Bytes of the pieces; space marks become spaces."""
        if self.byte_of.keys().isdisjoint(ids):
            return b"".join([self.piece_bytes[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace").encode())
                run = bytearray()
            out.append(self.piece_bytes[i])
        if run:
            out.append(run.decode("utf-8", "replace").encode())
        return b"".join(out)

    def described(self, ids: list[int]) -> tuple[int, str, bytes]:
        """(number of ids, ids as text, decoded bytes)."""
        texts = self.id_text
        return len(ids), ",".join([texts[i] for i in ids]), self.decode_bytes(ids)

    def bound(self) -> None:
        """Cut down what has grown beyond its number of entries; the first units are the most frequent ones."""
        if len(self.units) > MEMO_UNITS:
            self.units = dict(islice(self.units.items(), KEPT_UNITS))
        if self.pairs.count > MEMO_PAIRS:
            self.pairs.clear()

    def learn(self, parts: Iterable[str]) -> None:
        """Encode the parts that are not known yet, in groups."""
        new = [p for p in parts if p not in self.units]
        short = [p for p in new if len(p) < LONG and "\n" not in p[1:]]
        for lo in range(0, len(short), TOGETHER):
            group = short[lo : lo + TOGETHER]
            # A part after a line feed has no space mark; the line feed itself is a byte.
            encoded = self.encode_units([p[1:] if p[:1] == "\n" else MARK + p for p in group])
            feed = self.bytes[10]
            for part, ids in zip(group, encoded):
                self.units[part] = self.described([feed, *ids] if part[:1] == "\n" else ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin and end ids."""
        if not text:
            return []
        self.bound()
        return [i for u in UNIT.findall(MARK + text.replace(" ", MARK)) for i in self.encode_unit(u)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding puts in front is taken off."""
        text = self.decode_bytes(ids).decode()
        return text[1:] if text.startswith(" ") else text

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, hash of the ids, hash of the decoded text) of whole texts."""
        self.bound()
        cut = [parts_of(t) for t in texts]
        self.learn(set(chain.from_iterable(p for p in cut if p is not None)))
        out = []
        for text, parts in zip(texts, cut):
            if parts is None:
                units = [self.described(self.encode(text))]
            else:
                known = self.units
                units = [known[p] if p in known else self.described(self.encode_part(p)) for p in parts]
            ids = ",".join([u[1] for u in units])
            decoded = b"".join([u[2] for u in units])
            decoded = decoded[1:] if decoded.startswith(b" ") else decoded
            out.append((sum([u[0] for u in units]), sha256(ids.encode()).hexdigest(), sha256(decoded).hexdigest()))
        return out

    def encode_part(self, part: str) -> list[int]:
        if part[:1] == "\n":
            return [self.bytes[10], *self.encode_unit(part[1:])]
        return self.encode_unit(MARK + part)


def parts_of(text: str) -> list[str] | None:
    """Units without their space mark, or with the line feed before them; None: cut by the pattern.

    A text with repeated, leading or trailing spaces or a space mark of its own is cut by the pattern.
    """
    spread = text.replace("\n", " \n")
    if not text or "  " in spread or spread[0] == " " or spread[-1] == " " or MARK in text:
        return None
    return spread.split(" ")


_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """The model of this process; built once per worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and their decoded text for every row: doc_id, ids, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", forget: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; texts pass whole, in Arrow batches.

    forget: drop the model, its units and pair tables with each task, where other work follows on the same workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path)
        for batch in batches:
            parts = (batch.column("text").slice(lo, GROUP_ROWS).to_pylist() for lo in range(0, batch.num_rows, GROUP_ROWS))
            found = [d for part in parts for group in grouped([t or "" for t in part], GROUP_CHARS) for d in model.digests(group)]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        if forget:
            # The waiting process would keep its pair tables and Arrow's free pages beside the executor's heap.
            model.units.clear()
            _models.pop(model_path, None)
            del model
            gc.collect()
            pa.default_memory_pool().release_unused()

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
