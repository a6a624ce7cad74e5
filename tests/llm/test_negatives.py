"""Hard negatives against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tillflow.llm import hard_negatives
from tillflow.llm.queries import QUERIES


def plain(rows, is_anchor):
    """rows: (id, label, vector); repeats count once."""
    held = []
    for i, label, vector in {(i, label, None if v is None else tuple(v)) for i, label, v in rows}:
        if i is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            held.append((i, label, [math.floor(256 * x) for x in vector]))
    out = []
    for a in held:
        if not is_anchor(a[0]):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in held if b is not a), key=lambda s: s[:2])
        for s, positive, _ in [s for s in scored if s[2] == a[1]][:5]:
            near = [(-t, n) for t, n, label in scored if label != a[1] and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a[0], positive, k + 1, n, -s, t) for k, (t, n) in enumerate(near[:3])]
    return sorted(out)


def mined(spark, rows, step=4, schema="vec_id long, label int, embedding array<float>, id string, score string", parts=3):
    frame = spark.createDataFrame([(i, label, v, "x", "y") for i, label, v in rows], schema).repartition(parts)
    found = hard_negatives.mine(frame, F.col("vec_id") % step == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def vectors(rng, n, dims=8, labels=3, grain=8):
    return [(i, rng.randrange(labels), [rng.randint(-grain, grain) / grain for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("blocks", [1, 7])
def test_mined_rows_equal_all_pairs(spark, blocks, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", -(-400 // blocks))
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 100 // min(blocks, 3))
    rows = vectors(random.Random(1), 400)
    # Ties: equal vectors under other ids and labels; a zero vector; rows that take no part.
    rows += [(1000 + i, i % 3, v) for i, (_, _, v) in enumerate(rows[:60])]
    rows += [(2000, 0, [0.0] * 8), (2004, 1, [0.0] * 8), (2001, None, [1.0] * 8), (2002, 1, None), (2003, 1, [1.0, None] + [0.0] * 6)]
    rows += [(2008, 1, [float("nan")] * 8), (2012, 1, [float("inf")] + [0.0] * 7), (None, 1, [1.0] * 8)]
    want = plain(rows, lambda i: i % 4 == 0)
    assert mined(spark, rows) == want and len(want) > 500 and any(w[4] == 0 for w in want)


def test_repeats_lengths_and_empty_tables(spark):
    rows = vectors(random.Random(2), 60) + [(3, 1, [1.0]), (5, 2, [1.0, -1.0, 0.5]), (8, 0, []), (12, 1, [2.0] * 11)]
    want = plain(rows, lambda i: i % 4 == 0)
    assert mined(spark, rows + rows[:20] * 5) == want and want
    # An id with two vectors is two rows, each an anchor of its own.
    twice = vectors(random.Random(3), 40) + vectors(random.Random(4), 12)
    assert mined(spark, twice) == plain(twice, lambda i: i % 4 == 0)
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [float(rng.randint(10**6, 10**6 + 50)) for _ in range(4)]) for i in range(80)]
    want = plain(rows, lambda i: i % 4 == 0)
    close = [(i, 1 - i % 2, [x * 0.9 for x in v]) for i, _, v in rows]
    rows += [(100 + i, label, v) for i, label, v in close]
    schema = "vec_id long, label int, embedding array<double>, id string, score string"
    want = plain(rows, lambda i: i % 4 == 0)
    assert mined(spark, rows, schema=schema) == want and max(w[4] for w in want) > 2**53


def test_search_stops_before_all_rows_are_seen():
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(size=(4000, 2)) * 256)
    lists = hard_negatives.Lists(np.arange(4000), vectors, 2000.0)
    anchor = np.array([300.0, -500.0])
    rows, scores = lists.search(anchor, lambda _, s, t: t is None or (len(s) >= 3 and t < np.sort(s)[-3]))
    assert len(rows) < 2000 and set(np.sort(scores)[-3:]) == set(np.sort(vectors @ anchor)[-3:])


def test_query(spark, sf):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, sf).collect())) == plain(rows, lambda i: i % 50 == 0)
