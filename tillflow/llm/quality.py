"""Quality rules as a short-circuit cascade, cheapest rejection first.

Each rule is one boolean expression over features of a text. Its cost (seconds to evaluate it alone) and
selectivity (share of texts it rejects) are measured on a bounded sample, and the rules are ordered by
rejection per cost. The cascade is one CASE expression, so a text that an early rule rejects never pays for
a later one. The order changes the cost only: a text is kept if no rule rejects it.

All steps are DataFrame and SQL expressions; window positions of one text are handled inside its row by
array functions in O(n log n). Hashes only screen texts without a repeat; where one is found, the windows
themselves are compared.

Defined cases: NULL and blank texts have no words and are rejected by the base rule (fewer than ten
words); very long texts are read whole; repeated rows are judged alike; an empty table gives an empty
result (the rules then keep the order in which they are given); other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.session import materialize

from .words import GAP, let, words_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Rows of the sample on which cost and selectivity are measured; results do not depend on it.
SAMPLE_ROWS = 500


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more in the text."""

    def windows(w: Column) -> Column:
        return F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))

    def screened(w: Column) -> Column:
        hashes = lambda h: F.transform(windows(w), lambda i: F.xxhash64(*[h[i + (k - 1)] for k in range(size)]))
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(hashes(h), lambda d: F.size(F.array_distinct(d)) < F.size(d)))

    def exact(w: Column) -> Column:
        listed = F.sort_array(F.transform(windows(w), lambda i: F.struct(F.array_join(F.slice(w, i, size), " ").alias("s"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: ((k > 0) & (F.get(s, k - 1)["s"] == x["s"])) | (F.get(s, k + 1)["s"] == x["s"])
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last"))
        return let(listed, lambda s: F.aggregate(twice(s), start, step)["n"])

    return let(words, lambda w: F.when(screened(w), exact(w)).otherwise(F.lit(0))).cast("long")


def features(text: Column) -> dict[str, Column]:
    """Named features of a text as expressions."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words_of(text)),
    }


@dataclass(frozen=True)
class Rule:
    """A rule rejects a text when its condition is true."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda f: f["n_words"] < MIN_WORDS),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > REPEAT_PERCENT * f["n_words"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("symbols", lambda f: 10 * f["n_symbols"] > 3 * f["n_words"]),
    Rule("repeated_lines", lambda f: (f["n_dup_lines"] > 2) & (10 * f["n_dup_lines"] > 3 * f["n_lines"])),
)


def measured(sample: DataFrame, text_col: str, rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share) of each rule evaluated alone on a stored sample."""
    found = []
    for rule in rules:
        condition = F.coalesce(rule.rejects(features(F.col(text_col))), F.lit(False))
        begin = time.perf_counter()
        row = sample.agg(F.count_if(condition).alias("rejected"), F.count(F.lit(1)).alias("rows")).first()
        found.append((rule, time.perf_counter() - begin, row["rejected"] / max(row["rows"], 1)))
    return found


def ordered(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by rejection per cost on a bounded sample, largest first."""
    share = min(1.0, 2 * SAMPLE_ROWS / max(docs.count(), 1))
    sample = materialize(docs.select(text_col).sample(share, seed=7).limit(SAMPLE_ROWS), "quality-sample")
    return [rule for rule, cost, share in sorted(measured(sample, text_col, rules), key=lambda x: -x[2] / max(x[1], 1e-6))]


def verdict(rules: Sequence[Rule], values: dict[str, Column]) -> Column:
    """Name of the first rule of the cascade that rejects, NULL if none does."""
    cascade = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        cascade = cascade.when(rule.rejects(values), F.lit(rule.name))
    return cascade


def keep(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs without the rows that a rule rejects; all columns stay as they are."""
    return docs.where(verdict(ordered(docs, text_col, rules), features(F.col(text_col))).isNull())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Features of every row with the base verdict, the rejecting rule and the verdict of the cascade."""
    cascade = ordered(docs, text_col, rules)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in features(F.col(text_col)).items()])
    values = {n: F.col(n) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base).withColumn("rejected_by", verdict(cascade, values))
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("rejected_by").isNull()))
