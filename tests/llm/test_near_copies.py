"""The near-copy stage against brute-force similarity of five-word shingles."""

from __future__ import annotations

import random

import pytest

from loops import plain_roots

from tillflow.llm import exact_dedup, near_copies, quality


def varied():
    """Families of texts whose similarities lie around 0.8, texts with a common passage, short, equal and empty ones."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(60)]
    texts = [None, "", " \n", "One", "one", "one two three four", "ONE two\tthree four", "one two three five"]
    for size in (12, 40, 90, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for _ in range(10):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    copy[rng.randrange(size)] = word()
                texts.append(" ".join(copy[: rng.choice([size, size - size // 12])]))
    for _ in range(60):
        texts.append(" ".join(common + [word() for _ in range(rng.randint(5, 60))]))
    return texts


@pytest.mark.parametrize("hot", [24, 1])
def test_all_similar_texts_meet(spark, hot, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", hot)
    texts = varied()
    root = plain_roots(texts)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(4)
    kept = near_copies.drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and 100 < len(set(root)) < len(texts) - 100
    assert near_copies.drop_near_copies(frame.where("doc_id < 0")).count() == 0


def test_one_row_of_similar_texts_stays(spark):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven twelve"
    rows = [(5, a), (5, a), (5, b), (3, b.upper()), (3, b.upper()), (None, c), (None, c), (None, c.title()), (None, a)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == 3 and (5, a) in found and (3, b.upper()) in found and sum(d is None and t.lower() == c for d, t in found) == 1


def test_stage_drops_the_similar_documents(spark):
    """Of the given documents, those that reach the stage; two fingerprint bits missed most of their pairs."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = exact_dedup.drop_duplicates(quality.keep(docs))
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    root = plain_roots([t for _, t in rows])
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r["doc_id"] for r in stage(spark, before, "/root/testdata/sf0.01").collect()}
    assert kept == {d for i, (d, _) in enumerate(rows) if root[i] == i} and len(kept) < len(rows)


def test_close_fingerprints_link_without_a_shared_key(spark):
    """Nodes with no minimum-hash key in common meet by their fingerprints and are decided by their similarity."""
    from tillflow.llm import simhash

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    bits = lambda t: int.from_bytes(simhash.fingerprint(t, near_copies.SHINGLE), "big", signed=True)
    texts = []
    while not texts:
        base = [word() for _ in range(300)]
        pair = [" ".join(base), " ".join([*base[:-1], word()])]
        if 0 < ((bits(pair[0]) ^ bits(pair[1])) & (2**64 - 1)).bit_count() <= 2:
            texts = [*pair, " ".join(word() for _ in range(300))]
    sets = [near_copies.shingles(t) for t in texts]
    # The last one has the fingerprint of the first but not its shingles.
    marks = [bits(texts[0]), bits(texts[1]), bits(texts[0])]
    nodes = [(i, bytearray([i]), len(s), [i], b) for i, (s, b) in enumerate(zip(sets, marks))]
    frame = spark.createDataFrame(nodes, "node long, fp binary, size long, keys array<long>, bits long")
    prints = spark.createDataFrame([(bytearray([i]), bytearray(near_copies.packed(s))) for i, s in enumerate(sets)], "fp binary, set binary")
    assert [tuple(r) for r in near_copies.linked(frame, prints).select("a", "b").collect()] == [(1, 0)]
