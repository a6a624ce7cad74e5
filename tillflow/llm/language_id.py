"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word between its borders in both directions, from a fresh state at every
word, and gives every position a probability for each language. A document's probability is the mean over the
positions of all its words that hold a letter, so it covers the whole text. As a word gives the same
labels wherever it stands, each worker labels a word once and remembers it from batch to batch; the memo is
cleared at a fixed number of words, which affects speed alone.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows: at
most SAMPLE_DOCS rows per language, chosen by a hash of the id, and at most SAMPLE_WORDS words of each,
spread evenly over its text.

Defined cases: a NULL text and a text without a letter is `und` with score 0; rows without a language teach
nothing; ties go to the language that comes first in order; words of more than LONG bytes are read in pieces
of LONG bytes; without any labelled row every text is `und`; repeated rows get the same answer; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import grouped, let, words_of

SAMPLE_DOCS = 400
SAMPLE_WORDS = 120
TRAIN_WORDS = 48_000
HIDDEN = 12
EMBED = 8
EPOCHS = 2
#: A small sample is gone through more often, up to this many batches.
LEAST_BATCHES = 400
BATCH = 256
LONG = 24
GROUP = 8_192
MEMO_WORDS = 500_000
BORDER = 32  # a space stands before and after every word

_GATES = ("z", "r", "c")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of bordered words, one row each, and their lengths."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    width = int(sizes.max(initial=2))
    out = np.full((len(words), width), BORDER, dtype=np.uint8)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    inside = np.arange(width)[None, :]
    out[(inside >= 1) & (inside < (sizes - 1)[:, None])] = flat
    return out, sizes


def _reversed(matrix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every row read backwards within its length."""
    at = sizes[:, None] - 1 - np.arange(matrix.shape[1])[None, :]
    return np.take_along_axis(matrix, np.maximum(at, 0), axis=1)


@dataclass
class Network:
    """Weights of both directions and the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {"e": (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32), "bo": np.zeros(len(languages), np.float32)}
        for d in "fb":
            weights |= {f"w{d}": draw(EMBED, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 2 * HIDDEN), f"v{d}": draw(HIDDEN, HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
            weights[f"o{d}"] = draw(HIDDEN, len(languages))
        return cls(languages, weights)

    def states(self, matrix: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden state after every byte of every row, (position, row, hidden)."""
        w, h = self.weights, np.zeros((len(matrix), HIDDEN), np.float32)
        inputs = w["e"] @ w[f"w{d}"] + w[f"b{d}"]  # the input part of each of 256 bytes
        out = np.empty((matrix.shape[1], len(matrix), HIDDEN), np.float32)
        trace = []
        for t in range(matrix.shape[1]):
            x = inputs[matrix[:, t]]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + h @ w[f"u{d}"])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ w[f"v{d}"])
            if keep:
                trace.append((h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out, trace

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        """Sum over the positions of each word of the languages' probabilities."""
        matrix, sizes = _matrix(words)
        w = self.weights
        forward = self.states(matrix, "f")[0] @ w["of"]
        backward = self.states(_reversed(matrix, sizes), "b")[0] @ w["ob"]
        at = sizes[None, :] - 1 - np.arange(matrix.shape[1])[:, None]
        logits = forward + np.take_along_axis(backward, np.maximum(at, 0)[:, :, None], axis=0) + w["bo"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        return (p * (at >= 0)[:, :, None]).sum(axis=0)

    def gradient(self, words: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy of all positions, through time."""
        matrix, sizes = _matrix(words)
        w, mirrored = self.weights, _reversed(matrix, sizes)
        forward, trace_f = self.states(matrix, "f", True)
        backward, trace_b = self.states(mirrored, "b", True)
        at = sizes[None, :] - 1 - np.arange(matrix.shape[1])[:, None]
        turn = np.maximum(at, 0)[:, :, None]
        logits = forward @ w["of"] + np.take_along_axis(backward @ w["ob"], turn, axis=0) + w["bo"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(words)), labels] -= 1.0
        p *= (at >= 0)[:, :, None] / float(sizes.sum())
        mirrored_p = np.take_along_axis(p, turn, axis=0) * (at >= 0)[:, :, None]
        grads = {"bo": p.sum(axis=(0, 1)), "e": np.zeros_like(w["e"])}
        for d, data, states, trace, error in (("f", matrix, forward, trace_f, p), ("b", mirrored, backward, trace_b, mirrored_p)):
            grads[f"o{d}"] = np.einsum("tnh,tnk->hk", states, error)
            du, dv = np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"v{d}"])
            into = np.zeros((256, 3 * HIDDEN), np.float32)
            back = np.zeros((len(words), HIDDEN), np.float32)
            for t in reversed(range(data.shape[1])):
                h, z, r, c = trace[t]
                g = back + error[t] @ w[f"o{d}"].T
                dc = g * z * (1 - c * c)
                through = dc @ w[f"v{d}"].T
                gates = np.concatenate((g * (c - h) * z * (1 - z), through * h * r * (1 - r)), axis=1)
                du += h.T @ gates
                dv += (r * h).T @ dc
                np.add.at(into, data[:, t], np.concatenate((gates, dc), axis=1))
                back = g * (1 - z) + through * r + gates @ w[f"u{d}"].T
            grads |= {f"u{d}": du, f"v{d}": dv, f"b{d}": into.sum(axis=0), f"w{d}": w["e"].T @ into}
            grads["e"] += into @ w[f"w{d}"].T
        return grads


def train(words: list[bytes], labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam over shuffled batches of words of similar length."""
    network, rng, step = Network.fresh(languages, seed), np.random.default_rng(seed), 0
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    order = np.argsort([len(w) for w in words], kind="stable")
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    epochs = max(epochs, -(-LEAST_BATCHES // len(batches)))
    total = epochs * len(batches)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)).tolist():
            step += 1
            grads = network.gradient([words[i] for i in batches[b].tolist()], labels[batches[b]])
            speed = rate * (1 - 0.9 * step / total)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                network.weights[k] = (network.weights[k] - speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Words with the number of their language, from a bounded choice of labelled rows."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros(0, np.int64), []
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, SAMPLE_DOCS / counts[k]))]), F.col(lang_col))
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    spread = let(words_of(F.col(text_col)), lambda w: F.filter(w, lambda x, i: F.pmod(i, F.ceil(F.size(w) / SAMPLE_WORDS).cast("int")) == 0))
    rows = chosen.select(F.col(lang_col).alias("lang"), F.transform(spread, lambda x: F.substring(x, 1, LONG)).alias("words")).limit(2 * SAMPLE_DOCS * len(languages)).collect()
    words, labels = [], []
    for row in rows:
        held = [w.encode()[:LONG] for w in row["words"] if any(c.isalpha() for c in w)]
        words += held
        labels += [languages.index(row["lang"])] * len(held)
    # The same number of words for each language, in a fixed order.
    rng, picked, known = np.random.default_rng(3), [], np.array(labels)
    for k in range(len(languages)):
        own = np.array(sorted(np.flatnonzero(known == k).tolist(), key=lambda i: words[i]), dtype=np.int64)
        picked += rng.permutation(own)[: TRAIN_WORDS // len(languages)].tolist()
    return [words[i] for i in picked], known[picked], languages


class Labeller:
    """Pooled probabilities of documents; words are labelled once per worker process."""

    def __init__(self, network: Network):
        self.network = network
        self.number: dict[str, int] = {}
        self.sums = np.zeros((0, len(network.languages) + 1), np.float32)

    def learn(self, words: list[str]) -> None:
        pieces, owner = [], []
        for i, word in enumerate(words):
            self.number[word] = len(self.sums) + i
            if any(map(str.isalpha, word)):
                data = word.encode()
                for at in range(0, len(data), LONG):
                    pieces.append(data[at : at + LONG])
                    owner.append(i)
        sums = np.zeros((len(words), self.sums.shape[1]), np.float32)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for at in range(0, len(order), GROUP):
            group = order[at : at + GROUP]
            found = self.network.probabilities([pieces[i] for i in group])
            np.add.at(sums, np.array([owner[i] for i in group]), np.concatenate((found, found.sum(axis=1, keepdims=True)), axis=1))
        self.sums = np.concatenate((self.sums, sums))

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.number) > MEMO_WORDS:
            self.number, self.sums = {}, self.sums[:0]
        cut = [t.split() for t in texts]
        known = self.number
        self.learn(list(dict.fromkeys(w for words in cut for w in words if w not in known)))
        languages, scores = [], []
        for words in cut:
            total = self.sums[list(map(known.__getitem__, words))].sum(axis=0, dtype=np.float64) if words else np.zeros(1)
            if total[-1] <= 0:
                languages.append("und")
                scores.append(0.0)
            else:
                best = int(np.argmax(total[:-1]))
                languages.append(self.network.languages[best])
                scores.append(float(min(1.0, total[best] / total[-1])))
        return languages, scores


_labellers: dict[bytes, Labeller] = {}


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    key = b"".join(network.weights[k].tobytes() for k in sorted(network.weights))[:4096] + repr(network.languages).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _labellers:
            _labellers.clear()
            _labellers[key] = Labeller(network)
        for batch in batches:
            found = [_labellers[key].label(group) for group in grouped([t or "" for t in batch.column("text").to_pylist()])]
            languages, scores = [x for f in found for x in f[0]], [x for f in found for x in f[1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    """True for the quarter of ids that teaches nothing."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, then label every row: doc_id, held_out, lang_pred, score."""
    words, labels, languages = sample(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    network = train(words, labels, languages) if words else Network.fresh(["und"])
    found = predict(docs, network, id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.when(F.col("lang_pred") == "und", 0.0).otherwise(F.col("score")).alias("score"))
