"""Fill-in-middle against slicing of strings."""

from __future__ import annotations

import random
from hashlib import sha256

from tillflow.llm import fill_middle
from tillflow.llm.queries import QUERIES


def plain(doc_id, text):
    text = text or ""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def texts():
    rng = random.Random(6)
    out = [None, "", "a", "<", "<P>", "x<S>y", "<M", "日本語のテキスト", "é 👩‍👩‍👧", "<<<<>>>>", "S><P", "long " * 100_000]
    return out + ["".join(rng.choices("ab<>PSM日é👍\n", k=rng.randint(0, 14))) for _ in range(800)]


def test_pieces_equal_slices(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "GROUP_CHARS", 500)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(2, "a", "x", 1), (None, "abc", "x", 1), (-7, "negative id", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, output string, h1 int").repartition(3)
    found = fill_middle.restore(fill_middle.transform(frame)).collect()
    key = lambda r: repr((r[0], r[1], r[-1]))
    assert sorted((tuple(r) for r in found), key=key) == sorted(((i, *plain(i, t), t or "") for i, t, *_ in rows), key=key)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(frame.where("false"))).count() == 0


def test_query(spark, sf):
    held = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op13_fill_middle"](spark, sf).collect()
    assert len(found) == len(held)
    for r in found:
        n, form, prefix, middle, output = plain(r["doc_id"], held[r["doc_id"]])
        restored = sha256((held[r["doc_id"]] or "").encode()).hexdigest()
        assert tuple(r) == (r["doc_id"], n, form, prefix, middle, sha256(output.encode()).hexdigest(), restored)
