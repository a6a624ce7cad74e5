"""License scans against plain loops and a recursive reading of expressions."""

from __future__ import annotations

import random
import re

import pytest

from tillflow.llm import license_scan
from tillflow.llm.license_scan import BASE, NOTICES, family, parse
from tillflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE_COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    words = words_of(text)
    places = [(i, label) for i in range(len(words)) for phrase, label in BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def plain_notices(text):
    joined = f" {' '.join(words_of(text))} "
    return {label for phrase, label in NOTICES.items() if f" {phrase} " in joined}


def texts():
    rng = random.Random(3)
    parts = ["MIT", "mit", "License", "license", "LICENSE,", "Apache", "General", "Public", "general-public", "GNU", "é", "日本", "x9", ".", "\n", "\x00", "licence:", "BSD", "or", "(", "Creative Commons"]
    out = [None, "", " \n.", "MIT License", "mit license mit license", "Apache\nLicense", "general  public—license", "general public license general public license", "MIT License", "İmit license"]
    out += [" ".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)] + ["mit license " * 20_000]
    return out


def test_base_places_equal_a_loop(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(3, "MIT License", "x", "y"), (None, "Apache License", "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, labels string, score string").repartition(3)
    found = sorted(((r["doc_id"], *[r[c] for c in BASE_COLUMNS]) for r in license_scan.scan(frame).collect()), key=repr)
    assert found == sorted(((i, *plain_base(t)) for i, t, *_ in rows), key=repr)
    for r in license_scan.scan(frame).collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"])
    assert license_scan.scan(frame.where("false")).count() == 0


def test_query(spark, sf):
    held = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op12_license_scan"](spark, sf).collect()
    assert len(found) == len(held)
    for r in found:
        text = held[r["doc_id"]]
        assert tuple(r[c] for c in BASE_COLUMNS) == plain_base(text)
        assert plain_notices(text) <= set(r["labels"].split(","))
    assert any(r["labels"] for r in found)


def recursive(tokens):
    """(labels, permissive) by recursive descent over a whole expression."""
    at = 0

    def primary():
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "(":
            value = level(1)
            at += 1
            return value
        label, permissive = family(token, True)
        if at < len(tokens) and tokens[at] == "with":
            at += 2
        return {label}, permissive

    def level(n):
        nonlocal at
        value = primary() if n == 3 else level(n + 1)
        while at < len(tokens) and tokens[at] == {1: "or", 2: "and"}.get(n):
            at += 1
            other = level(n + 1)
            value = value[0] | other[0], (value[1] or other[1]) if n == 1 else (value[1] and other[1])
        return value

    return level(1)


def expression(rng, depth=0):
    ids = ["mit", "apache-2.0", "gpl-2.0-only", "lgpl-2.1+", "bsd-3-clause", "isc", "weird-1.0", "cc0-1.0", "cc-by-nc-4.0"]
    if depth > 3 or rng.random() < 0.4:
        return [rng.choice(ids)] + (["with", "classpath-exception-2.0"] if rng.random() < 0.2 else [])
    out = expression(rng, depth + 1)
    for _ in range(rng.randint(1, 3)):
        out += [rng.choice(["and", "or"]), *expression(rng, depth + 1)]
    return ["(", *out, ")"] if rng.random() < 0.6 else out


def test_expressions_equal_a_recursive_reading():
    rng = random.Random(9)
    for _ in range(2000):
        tokens = expression(rng)
        labels, permissive = recursive(tokens)
        found = parse(" ".join(tokens))
        assert (set(found.labels), found.permissive, found.end) == (labels, permissive, len(" ".join(tokens)))


@pytest.mark.parametrize(
    "line, labels, permissive",
    [
        ("mit or", {"mit"}, True),
        ("mit and (bsd", {"mit"}, True),
        ("(mit", None, None),
        ("and mit", None, None),
        (")", None, None),
        ("", None, None),
        ("mit or gpl-3.0 and foo bar", {"mit", "gpl", "foo"}, True),
        ("(mit or gpl-3.0) and agpl-3.0.", {"mit", "gpl", "agpl"}, False),
        ("gpl-2.0 with (x)", {"gpl"}, False),
    ],
)
def test_longest_expression_at_the_front(line, labels, permissive):
    found = parse(line)
    assert (found and (set(found.labels), found.permissive)) == (labels and (labels, permissive))


def test_tags_in_code_and_prose():
    scan = license_scan.Scanner().scan
    assert scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */")[5:] == ("apache,gpl,mit", False, ["apache,gpl,mit"], 1.0)
    assert scan("Licensed under CC BY-NC 4.0. Enjoy.")[5:] == ("cc-by-nc", False, ["cc-by-nc"], 0.9)
    assert scan("Licensed under the Apache License, Version 2.0")[5:7] == ("apache", True)
    assert scan("The license: it is good, or not")[5:] == ("", None, [], 0.0)
    assert scan("Permission is hereby granted, free of charge, to any person obtaining a copy")[5] == "mit"
    assert scan("license-expression: (a or " * 3000)[8] == 0
