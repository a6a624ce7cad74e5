"""Files read in byte ranges, hash trees of files and logs, running states over buckets."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tillflow.operators import prefix, trees
from tillflow.sources import files, splits


@pytest.fixture()
def small_splits(spark):
    """Ranges of 300 bytes, so that small files have many."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "300")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plain_root(digests, fanout):
    while len(digests) > 1:
        groups = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        digests = [g[0] if len(g) == 1 else hashlib.sha256(("node:" + "".join(g)).encode()).hexdigest() for g in groups]
    return digests[0]


def test_states_and_sums_before(spark):
    draw = random.Random(5)
    data = [(k, b, i, draw.random() < 0.4, draw.random() < 0.5) for k in ("a", None) for b in (None, *range(7)) for i in range(draw.choice((1, 3, 9)))]
    df = spark.createDataFrame(data, "k string, b int, i int, off boolean, on boolean").repartition(3)
    got = prefix.switches_before(df, ["k"], "b", ["i"], F.col("off"), F.col("on"), "state")
    summed = prefix.sums_before(df, ["k"], "b", ["i"], {"n": F.col("i").cast("long")})
    want, sums = {}, {}
    for key in ("a", None):
        state, total = False, 0
        for k, b, i, off, on in data:
            if k == key:
                want[k, b, i], sums[k, b, i] = state, total
                state, total = (on if state else off), total + i
    assert {(r.k, r.b, r.i): r.state for r in got.collect()} == want
    assert {(r.k, r.b, r.i): r.n for r in summed.collect()} == sums


@pytest.mark.parametrize("delimiter,end", [(",", "\n"), (";", "\r\n"), ("|", "\n"), ("\t", "\n")])
def test_csv_in_ranges(spark, tmp_path, small_splits, delimiter, end):
    draw = random.Random(len(end) * 7 + ord(delimiter))
    parts = ['"', '""', "\n", delimiter, "a", "bc d", "5\" x", "é", "\n\n", " "]
    rows = [[str(i), "".join(draw.choice(parts) for _ in range(draw.choice((0, 1, 4, 40)))), draw.choice(["", "z", 'q"r'])] for i in range(120)]
    for part, held in (("a", rows[:100]), ("b", rows[100:])):
        out = io.StringIO()
        out.write(delimiter.join(["id", " text ", "x"]) + end + end)
        for i, text, x in held:
            field = '"' + text.replace('"', '""') + '"' if draw.random() < 0.8 or set(text) & set('"\n' + delimiter) else text
            out.write(f"{i}{delimiter}{field}{delimiter}{x}{end}")
        (tmp_path / f"{part}.csv").write_bytes(out.getvalue().encode())
    assert splits.pieces(spark, str(tmp_path), "\n").select("path", "block").distinct().count() > 10
    got = splits.read_csv_ranges(spark, str(tmp_path), delimiter)
    seen = {r[0]: (r[1] or "", r[2] or "") for r in got.collect()}
    assert got.columns == ["id", " text ", "x"] and seen == {i: (t, x) for i, t, x in rows}
    options = dict(header=True, multiLine=True, quote='"', escape='"', sep=delimiter)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.read.options(**options).csv(str(tmp_path)).collect()))
    assert files.read_csv(spark, str(tmp_path), delimiter).columns == ["id", "text", "x"]


@pytest.mark.parametrize("delimiter", [",", "|", "x", "]^"])
def test_quoting_is_told_from_quotes_and_delimiters(spark, delimiter):
    """Lines are read twice for their quoting, so no pattern goes over whole texts."""
    draw = random.Random(len(delimiter))
    parts = ['"', '""', delimiter, delimiter[:1], "x", "bc d", "é", " ", "\r"]
    lines = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    marks = splits._marks(F.col("value"), delimiter)
    first = [splits._left_open(F.concat(F.lit(q), c), delimiter) for c in (F.col("value"), marks) for q in ("", '"')]
    rows = df.select(*first, F.length(marks)).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in rows) and 200 < sum(r[0] for r in rows) < 1800
    assert all(r[4] <= 2 * sum(x.count(c) for c in {'"', *delimiter}) + 1 for r, x in zip(rows, lines))


def test_json_array_in_ranges(spark, tmp_path, small_splits):
    draw = random.Random(3)
    parts = ["{", "}", "[", "]", '"', "\\", ",", "\n", "x", "ü", "}{"]
    rows = [{"id": i, "t": "".join(draw.choice(parts) for _ in range(draw.choice((0, 2, 60)))), "o": {"p": [{"q": draw.choice(parts)}, {}]}} for i in range(90)]
    (tmp_path / "one.json").write_text(json.dumps(rows[:70], ensure_ascii=False))
    (tmp_path / "two.json").write_text("﻿" + json.dumps(rows[70:], indent=2))
    assert splits.pieces(spark, str(tmp_path), "}").select("path", "block").distinct().count() > 10
    found = {json.loads(r.value)["id"]: json.loads(r.value) for r in splits.json_records(spark, str(tmp_path)).collect()}
    assert found == {r["id"]: r for r in rows}
    back = splits.read_json_ranges(spark, str(tmp_path))
    assert {r.id: (r.t, r.o.p[0].q) for r in back.collect()} == {r["id"]: (r["t"], r["o"]["p"][0]["q"]) for r in rows}
    (tmp_path / "one.json").write_text(json.dumps(rows)[:-40])
    with pytest.raises(splits.SplitError, match="one.json"):
        splits.json_records(spark, str(tmp_path))


def test_file_fingerprints_do_not_depend_on_ranges(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 50)}" for i in range(400)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("\n".join([lines[1], lines[0], *lines[2:]]))
    want = plain_root([hashlib.sha256(f"leaf:{len(x)}:{x}".encode()).hexdigest() for x in lines], 4)
    seen = []
    for size in ("300", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = {r.path[-5:]: (r.lines, r.fingerprint) for r in splits.file_fingerprints(spark, str(tmp_path), 4).collect()}
        assert found["a.txt"] == (400, want) and found["b.txt"][1] != want
        seen.append(found)
    assert seen[0] == seen[1]


def test_files_of_a_folder_are_one_text(spark, tmp_path, small_splits):
    """A text in several files, each written by its own task, has the fingerprint of the whole."""
    lines = [f"{i},{'x' * (i % 50)}" for i in range(400)]
    for folder, cuts in (("one", [0, 400]), ("two", [0, 130, 131, 400])):
        (tmp_path / folder).mkdir()
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / folder / f"part-{n:05d}.txt").write_text("".join(f"{x}\n" for x in lines[a:b]))
    want = plain_root([hashlib.sha256(f"leaf:{len(x)}:{x}".encode()).hexdigest() for x in lines], 4)
    found = splits.file_fingerprints(spark, f"{tmp_path}/*", 4, folders=True).collect()
    assert sorted((r.path[-3:], r.lines, r.fingerprint) for r in found) == [("one", 400, want), ("two", 400, want)]


def test_email_forms_agree():
    import re

    from tillflow.queries import basics

    draw = random.Random(8)
    texts = ["".join(draw.choice("aZ0_.-@ é@.") for _ in range(draw.randrange(14))) for _ in range(4000)]
    found = [bool(re.search(basics.EMAIL_FOUND, t)) for t in texts]
    assert found == [bool(re.search(basics.EMAIL_ANY, t)) for t in texts] and 100 < sum(found) < 3900


def test_log_tree_finds_changed_lost_and_added_records(spark):
    data = [(k, i, i // 7, f"e{i % 3}") for k in ("a", "b", None) for i in range(60 if k == "a" else 5)]
    log = spark.createDataFrame(data, "k string, i int, day int, body string").repartition(3)
    sealed = trees.seal_log(log, ["k"], "day", ["i"])
    stored = trees.log_tree(sealed, ["k"], ["i", "body"], 4)
    roots = {r.k: r.digest for r in stored[-1].collect()}
    for key in ("a", "b", None):
        leaves = [hashlib.sha256(f"leaf:{len(str(i))}:{i}{len(t)}:{t}".encode()).hexdigest() for k, i, _, t in data if k == key]
        assert roots[key] == plain_root(leaves, 4)

    def check(log):
        return {r.k: (r.records, r.broken, r.first_broken, r.valid) for r in trees.verify_log(log, stored, ["k"], ["i", "body"], 4).collect()}

    assert check(sealed) == {"a": (60, 0, None, True), "b": (5, 0, None, True), None: (5, 0, None, True)}
    forged = sealed.withColumn("body", F.when((F.col("k") == "a") & F.col("position").isin(17, 44), "x").otherwise(F.col("body")))
    assert check(forged)["a"] == (60, 2, 17, False) and check(forged)["b"][3]
    gone = sealed.where("NOT (k <=> NULL AND position = 3)")
    assert check(gone)[None] == (4, 1, 3, False)
    more = sealed.unionByName(sealed.where("k = 'b' AND position = 4").withColumn("position", F.lit(300).cast("long")))
    assert check(more)["b"] == (6, 1, 300, False)
