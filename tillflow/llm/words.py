"""Words and small expression helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text in order; NULL and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name inside one expression, so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


#: Characters of text that a worker cuts into words at a time.
GROUP_CHARS = 4_000_000


def grouped(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in groups of about `limit` characters; every text is whole and in one group."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group
