"""License scans: identifier tags and notice phrases by automaton, license expressions by operator precedence.

One Aho-Corasick automaton holds the phrases over words: a text is lowered (A-Z only), everything that is not a
word becomes one space, and a phrase is searched with a space on either side, so that it stands on whole words
and phrases may share a border. Base phrases name a license by themselves; notices are sentences that stand in
license texts. A second automaton finds identifier tags in the lowered text as it is written, and what follows a tag
on its line is read as a license expression: identifiers, parentheses, "and", "or", "with", binding in the order
with, and, or. A shunting-yard pass turns it into postfix order and evaluates it on the way. Words after the longest
expression that stands at the front are not part of it, so that a tag inside a sentence is read as well.

An expression is evaluated to its labels and to whether it can be met by permissive licenses alone: an identifier by
its family, "and" if both sides can, "or" if one can, "with" as its license without the exception. One truth value
stands for an operand, whatever the nesting; alternatives are never multiplied out, and every character is read once.

score is the strongest evidence of a text: a tag whose whole line is an expression, a tag with an expression at the
front, a notice, a base phrase; 0 without any.

Defined cases: NULL and blank texts have no words, no places, empty labels and score 0; very long texts and lines are
read whole; a tag without an expression adds nothing; identifiers of no known family are their own label; repeated
rows and rows with NULL ids are scanned one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences of license texts and usual notices, and their labels. Fixed values.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit": "mit",
    "licensed under the apache": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "mozilla public license": "mpl",
    "subject to the terms of the mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons": "cc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
}
#: Openings of a license expression, as written.
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:", "license:", "licence:", "licensed under", "released under")
#: (prefix of an identifier, label, permissive); the first prefix that fits counts. Fixed values.
FAMILIES = (
    ("mit", "mit", True),
    ("apache", "apache", True),
    ("agpl", "agpl", False),
    ("lgpl", "lgpl", False),
    ("gpl", "gpl", False),
    ("bsd", "bsd", True),
    ("0bsd", "bsd", True),
    ("isc", "isc", True),
    ("mpl", "mpl", False),
    ("epl", "epl", False),
    ("bsl-", "bsl", True),
    ("zlib", "zlib", True),
    ("unlicense", "unlicense", True),
    ("cc0", "cc0", True),
    ("cc-by-nc", "cc-by-nc", False),
    ("cc-by-nd", "cc-by-nd", False),
    ("cc-by-sa", "cc-by-sa", False),
    ("cc-by", "cc-by", True),
    ("python-", "python", True),
    ("postgresql", "postgresql", True),
    ("artistic-", "artistic", False),
)
#: An identifier of no family counts in prose only if it looks like one: a name with a version.
VERSIONED = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*-\d+(?:\.\d+)*\+?(?:-[a-z0-9]+)*")
#: Tags after which any word is an identifier; after the others, prose may follow.
STRICT = TAGS[:3]
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
SCORE_TAG, SCORE_FRONT, SCORE_NOTICE, SCORE_BASE = 1.0, 0.9, 0.8, 0.6

_KEPT = {b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A}
#: Lowered letters, and a space for every byte that is in no word.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_TOKEN = re.compile(r"\s*([()]|cc (?:by(?:-[a-z]{2})*|0)\b(?: \d+\.\d+)?|[^\s()\",;]+)")
_ARTICLE = re.compile(r"\s*(?:the\s+)?")
#: What may follow an expression that is a whole line: stops and ends of comments.
_REST = re.compile(r"[\s.,;:*/#>-]*")


@dataclass(frozen=True)
class Expression:
    """Labels of its identifiers, whether permissive licenses alone can meet it, and where it ends."""

    labels: frozenset[str]
    permissive: bool
    end: int


def family(identifier: str, strict: bool) -> tuple[str, bool] | None:
    """(label, permissive) of one identifier; None for a word that names no license."""
    name = identifier.rstrip(".,;:")
    for prefix, label, permissive in FAMILIES:
        if name.startswith(prefix):
            rest = name[len(prefix) :]
            if not rest or prefix[-1] == "-" or not rest[0].isalpha():
                return label, permissive
    if name and (strict and any(c.isalnum() for c in name) or VERSIONED.fullmatch(name)):
        return name, False
    return None


def _fold(values: list[bool], operators: list[str], least: int) -> None:
    """Apply the waiting operators that bind as tightly as `least`, down to an open parenthesis."""
    while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= least:
        right, left = values.pop(), values.pop()
        values.append({"with": left, "and": left and right, "or": left or right}[operators.pop()])


def parse(text: str, at: int = 0, stop: int | None = None, strict: bool = True) -> Expression | None:
    """The longest license expression at the front of text[at:stop], lowered; one shunting-yard pass.

    After every operand outside of parentheses what has been read is an expression; if the rest does not go on as one,
    the last of them holds. Its value is found on a copy of the open operators, of which there are three at most then.
    """
    stop = len(text) if stop is None else stop
    values: list[bool] = []
    operators: list[str] = []
    labels: list[str] = []
    depth, operand, best = 0, True, None
    while m := _TOKEN.match(text, at, stop):
        token, at = m[1].replace(" ", "-"), m.end()
        if operand and token == "(" and operators[-1:] != ["with"]:
            operators.append(token)
            depth += 1
            continue
        if not operand and token in PRECEDENCE:
            _fold(values, operators, PRECEDENCE[token])
            operators.append(token)
            operand = True
            continue
        if operand:
            if token in PRECEDENCE or token in "()":
                break
            if operators[-1:] == ["with"]:
                values.append(False)
            elif found := family(token, strict):
                labels.append(found[0])
                values.append(found[1])
            else:
                break
            operand = False
        elif token == ")" and depth:
            _fold(values, operators, 0)
            operators.pop()
            depth -= 1
        else:
            break
        if depth == 0:
            open_values = values[-len(operators) - 1 :]
            _fold(open_values, list(operators), 0)
            best = (len(labels), open_values[0], at)
            if token[-1] in ".:":  # the sentence ends here
                break
    return Expression(frozenset(labels[: best[0]]), best[1], best[2]) if best else None


class Scanner:
    """The two automata."""

    def __init__(self) -> None:
        self.phrases = ahocorasick.Automaton()
        for words in BASE.keys() | NOTICES.keys():
            self.phrases.add_word(f" {words} ", words)
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """(words, places, first place, last place, base labels, labels, permissive, expressions, score) of a whole text."""
        data = (text or "").encode()
        words = data.translate(_WORDS).split()
        joined = f" {b' '.join(words).decode()} "
        places: list[int] = []
        labels: set[str] = set()
        base: set[str] = set()
        score, at, passed = 0.0, 0, 0
        # Ends of matches come in order; places are counted by spaces, each stretch once.
        for end, phrase in self.phrases.iter(joined):
            if phrase in NOTICES:
                labels.add(NOTICES[phrase])
                score = max(score, SCORE_NOTICE)
            if phrase in BASE:
                start = end - len(phrase) - 1
                passed += joined.count(" ", at, start)
                at = start
                places.append(passed)
                base.add(BASE[phrase])
                score = max(score, SCORE_BASE)
        permissive: bool | None = None
        found: list[str] = []
        lowered = data.translate(_LOWER).decode()
        until, stop = 0, -1
        for end, tag in self.tags.iter(lowered):
            if end < until:
                continue
            if end >= stop:
                stop = lowered.find("\n", end)
                stop = len(lowered) if stop < 0 else stop
            strict = tag in STRICT
            value = parse(lowered, _ARTICLE.match(lowered, end + 1, stop).end(), stop, strict)
            # Of tags that end together the longest comes first; tags inside an expression belong to it.
            until = value.end if value else end + 1
            if value:
                labels |= value.labels
                found.append(",".join(sorted(value.labels)))
                permissive = value.permissive if permissive is None else permissive and value.permissive
                whole = strict and _REST.match(lowered, value.end, stop).end() == stop
                score = max(score, SCORE_TAG if whole else SCORE_FRONT)
        order = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), *order, ",".join(sorted(base)), ",".join(sorted(base | labels)), permissive, found, score


_scanners: list[Scanner] = []
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "permissive boolean, expressions array<string>, score double"
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanners:
        _scanners.append(Scanner())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.float64()]
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        found = [_scanners[0].scan(t.as_py()) for t in batch.column("text")]
        columns = list(zip(*found)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the places of the base phrases, labels of all methods, the evaluated expressions and the score.

    permissive is NULL without an expression, else whether all expressions can be met by permissive licenses alone.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run, RESULT)
