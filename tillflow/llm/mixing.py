"""Mixing sources to target weights by Pareto order sampling.

Targets in words are set per source by weight, capped at a multiple of the source and the excess shared
again. A source with target t and s words gives every document floor(t / s) certain copies. What is left,
t - s * floor(t / s) words, is sampled with one more copy of a document at most. Inclusion chances are unequal
within a source: they are in proportion to the bits of a document's word count (1 for one word, 10 for 512 to
1,023), so longer documents are likelier to repeat, and their expected words add up to what is left. Where
such a chance would exceed one, the documents of that class get a certain copy and the rest is shared among the
shorter ones. The others are ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)),
and the smallest ranks are taken until their words reach what is left; the sample has a fixed size in words up
to half of one document. Ranks are held as odds / (1 + odds), which keeps their order within (0, 1).

u comes from a hash of the id, so reruns agree. Ranks are never sorted globally: they are cut into 65,536 bins,
words are summed per source and bin, and only documents of one bin of a source are ordered together. Decisions
are one row per source and class of bits, at most 64 a source.

Defined cases: a NULL text has no words; the NULL source is a source of its own, last in order; documents
without words take part in certain copies but never in the sample; repeated ids share u; ties
in rank are ordered by id and size; an empty table gives an empty result; other columns are not read, and are
kept under any name by mixed_rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillflow.session import materialize

from .words import word_count

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BINS = 65_536
SEED = "mix-1"


def chance(id_col: Column, seed: str = SEED) -> Column:
    """Uniform number in (0, 1) from 48 bits of a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target.

    The level is the words that a weight of one gets; sources whose cap lies below weight x level get
    their cap. Sources are walked by cap / weight, so the level is found in one pass over them.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    walk = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = walk.rowsBetween(W.unboundedPreceding, -1)
    after = walk.rowsBetween(W.currentRow, W.unboundedFollowing)
    wanted = F.lit(total) * F.sum("source_size").over(W.partitionBy())
    table = table.withColumn("level", (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # The level rises while sources are capped and falls after the first that is not: its largest value counts.
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy())
    full = F.col("cap").cast("double")
    return table.select("source", "source_size", F.least(full, F.coalesce(level * F.col("weight"), full)).alias("target"))


def bits_of(size: Column) -> Column:
    """Binary digits of a word count, 0 for none."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def chances(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """One row per (source, bits): source_size, target, certain copies, chance p of one more, words left for the sample.

    p = min(1, level x bits), where the level makes the expected words of all classes add up to what is left; classes
    are walked from the longest documents down, as those reach one first.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    classes = sizes.groupBy("source", bits_of(F.col("size")).alias("bits")).agg(F.sum("size").alias("words"))
    table = classes.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "bits", "words", "source_size", "target", "whole", "left")
    walk = W.partitionBy("source").orderBy(F.col("bits").desc())
    longer = F.coalesce(F.sum("words").over(walk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("bits") * F.col("words")).over(walk.rowsBetween(W.currentRow, W.unboundedFollowing))
    table = table.withColumn("level", F.try_divide((F.col("left") - longer).cast("double"), rest.cast("double")))
    source = W.partitionBy("source")
    level = F.max(F.when((F.col("bits") > 0) & (F.col("level") * F.col("bits") <= 1), F.col("level"))).over(source)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(level * F.col("bits"), F.lit(1.0))))
    table = table.withColumn("p", F.when(F.col("bits") > 0, p).otherwise(F.lit(0.0)))
    certain = F.coalesce(F.sum(F.when(F.col("p") >= 1, F.col("words"))).over(source), F.lit(0))
    return table.select("source", "bits", "source_size", "target", "whole", "p", (F.col("left") - certain).alias("left"))


def decided_by(left: str, right: str) -> Column:
    """Join of documents with the decisions of their source and class."""
    return F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source")) & (F.col(f"{left}.bits") == F.col(f"{right}.bits"))


def cuts(sizes: DataFrame, goal: DataFrame, seed: str = SEED) -> DataFrame:
    """The chances with the largest (rank, id, size) that the sample takes of the source.

    At most 64 rows per source, so that deciding about a document needs no shuffle of its text.
    """
    table = materialize(chances(sizes, goal), "mix-chances")
    drawn = sizes.where("size > 0").withColumn("bits", bits_of(F.col("size"))).alias("d").join(table.where("p > 0 AND p < 1").alias("c"), decided_by("d", "c"))
    drawn = drawn.select("d.source", "doc_id", "size", "left", rank_of(chance(F.col("doc_id"), seed), F.col("p")).alias("rank"))
    drawn = drawn.withColumn("bin", F.floor(F.col("rank") * BINS))
    per_bin = drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    walk = W.partitionBy("source").orderBy("bin")
    per_bin = per_bin.withColumn("before", F.coalesce(F.sum("words").over(walk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    reaches = (F.col("before") + F.col("words") >= F.col("left")) | F.lead("bin").over(walk).isNull()
    edge = per_bin.withColumn("reaches", reaches).where("before < left AND reaches").select("source", "bin", "before")
    at_edge = drawn.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bin") == F.col("e.bin")))
    at_edge = at_edge.select("d.source", "d.doc_id", "d.size", "before", "left", "rank")
    order = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = at_edge.withColumn("reached", F.col("before") + F.sum("size").over(order))
    # A document is taken if that brings the words nearer to what is left.
    key = F.struct("rank", "doc_id", "size")
    ends = reached.groupBy("source").agg(F.max(F.when(2 * F.col("reached") - F.col("size") <= 2 * F.col("left"), key)).alias("last"), F.min("rank").alias("first"))
    # If none of the edge bin is taken, the cut lies just below its smallest rank: NULL comes before any id, 0 before any size.
    under = F.struct(F.col("first").alias("rank"), F.lit(None).cast(sizes.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("size"))
    ends = ends.select("source", F.coalesce("last", under).alias("cut"))
    return table.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select("g.source", "bits", "source_size", "target", "whole", "p", "cut")


def rank_of(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds, o, as o / (1 + o)."""
    odds = (u / (1 - u)) / (p / (1 - p))
    return odds / (1 + odds)


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], total: float, most: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(sizes of the documents, decisions per source and class), both stored."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = materialize(sizes, "mix-sizes")
    return sizes, materialize(cuts(sizes, targets(sizes, weights, total, most), seed), "mix-cuts")


def copies_of(doc_id: Column, size: Column, seed: str = SEED) -> Column:
    """Copies of a document beside the decisions of its source and class."""
    between = (F.col("p") > 0) & (F.col("p") < 1)
    key = F.struct(F.when(between, rank_of(chance(doc_id, seed), F.col("p"))).alias("rank"), doc_id.alias("doc_id"), size.alias("size"))
    more = (size > 0) & ((F.col("p") >= 1) | (between & (key <= F.col("cut"))))
    return (F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: str = SEED
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sizes, decided = plan(docs, id_col, text_col, source_col, weights, total, most, seed)
    joined = sizes.withColumn("bits", bits_of(F.col("size"))).alias("d").join(decided.alias("g"), decided_by("d", "g")).select("d.doc_id", "d.size", "source_size", "target", "whole", "p", "cut")
    joined = joined.withColumn("copies", copies_of(F.col("doc_id"), F.col("size"), seed))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: str = SEED
) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; its columns stay as they are."""
    _, decided = plan(docs, id_col, text_col, source_col, weights, total, most, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("doc_id"), word_count(F.col(f"`{text_col}`")).alias("size"))
    rows = rows.withColumn("bits", bits_of(F.col("size"))).alias("d").join(decided.alias("g"), decided_by("d", "g"))
    rows = rows.withColumn("copies", copies_of(F.col("doc_id"), F.col("size"), seed))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.when(F.col("copies") > 0, F.col("copies").cast("int"))))).select("row.*")
