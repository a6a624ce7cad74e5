"""Files whose records span lines, read in byte ranges by several tasks.

Spark's text source cuts a file at a separator and at byte ranges, and names the range of every piece. What
a range cannot know alone, whether it starts inside quotes or inside an object, is carried from range to range
by running states (``operators/prefix.py``), so neither a file nor a record list is held by one task. One task
numbers the pieces of one range; a record is put together from its pieces by (file, record).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import numbered, sums_before, switches_before
from ..operators.trees import FANOUT, leaf, tree
from ..session import materialize, shared_dir

AT = ["path"]


class SplitError(ValueError):
    """A file breaks the format that reading in ranges needs."""


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(path, block, seq, value): the text between separators, in order of (block, seq) in each file."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", separator).text(path).select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"), "value"
    )


def joined_records(parts: DataFrame, separator: str) -> DataFrame:
    """(path, record, value) of pieces with a record number."""
    held = parts.groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("_p"))
    return held.select("path", "record", F.array_join(F.transform("_p", lambda p: p["value"]), separator).alias("value"))


def _marks(line: Column, delimiter: str) -> Column:
    """The quotes and delimiters of a line, with one character for each run of others: all that tells of its quoting."""
    other = next(c for c in "xyzabc" if c not in delimiter)
    return F.regexp_replace(line, f'[^"{"".join(map(re.escape, delimiter))}]++', other)


def _left_open(marks: Column, delimiter: str) -> Column:
    """Does a line that starts outside quotes end inside? Doubled quotes go first, then whole quoted fields."""
    d = re.escape(delimiter)
    rest = F.regexp_replace(F.replace(marks, F.lit('""'), F.lit("")), f'(^|{d})"[^"]*"', "$1")
    return rest.rlike(f'(^|{d})"')


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(path, record, value): one row per CSV record, line breaks inside quotes kept; record 0 is the header.

    A quote opens a field only at its start, so a quote within an unquoted field is text. Lines end with a line
    feed, with or without a carriage return before it. Blank lines outside quotes are skipped.
    """
    lines = pieces(spark, path, "\n")
    # A line without quotes ends as it starts; of others only quotes and delimiters matter, and lines are read twice.
    quoted, marks = F.contains("value", F.lit('"')), _marks(F.col("value"), delimiter)
    lines = lines.withColumn("_off", F.when(quoted, _left_open(marks, delimiter)).otherwise(False))
    lines = lines.withColumn("_on", F.when(quoted, _left_open(F.concat(F.lit('"'), marks), delimiter)).otherwise(True))
    known = switches_before(lines, AT, "block", ["seq"], F.col("_off"), F.col("_on"), "inside").drop("_off", "_on")
    known = materialize(known.where(F.col("inside") | ~F.col("value").isin("", "\r")), "csv-lines")
    starts = sums_before(known, AT, "block", ["seq"], {"record": (~F.col("inside")).cast("long")})
    # Records that start before a line, less one, number its record where it continues one.
    return joined_records(starts.withColumn("record", F.when(F.col("inside"), F.col("record") - 1).otherwise(F.col("record"))), "\n")


def read_csv_ranges(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text, named by the header as Spark's reader names them."""
    options = {"quote": '"', "escape": '"', "sep": delimiter, "multiLine": "true"}
    names = spark.read.options(header="true", encoding="UTF-8", **options).csv(path).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = csv_records(spark, path, delimiter).where("record > 0")
    value = F.regexp_replace("value", "\r$", "")
    return rows.select(F.from_csv(value, schema, options).alias("r")).select("r.*").toDF(*names)


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the longest file; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, value): the objects of one JSON array per file, also where it has no line breaks.

    Pieces end at closing braces. Quotes outside escapes tell whether a piece starts inside a string; braces
    outside strings tell its depth. A file that does not end with the array's bracket raises, as it is cut short.
    """
    raw = pieces(spark, path, "}")
    ends = raw.groupBy("path").agg(F.max_by("value", F.struct("block", "seq")).alias("end"))
    cut = ends.where(~F.col("end").rlike(r"^[\x{FEFF}\s]*(\[\s*)?\]\s*$")).agg(F.min("path")).first()[0]
    if cut:
        raise SplitError(f"no JSON array of objects up to the end: {cut}")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    odd = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2 == 1
    known = switches_before(raw.withColumn("_odd", odd), AT, "block", ["seq"], F.col("_odd"), ~F.col("_odd"), "inside")
    ends_inside = F.col("inside") != F.col("_odd")
    whole = F.concat(F.when(F.col("inside"), '"').otherwise(""), bare, F.when(ends_inside, '"').otherwise(""))
    outside = F.regexp_replace(whole, '"[^"]*"', "")
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    step = opened.cast("long") - F.when(ends_inside, 0).otherwise(1)
    known = materialize(known.withColumn("step", step).drop("_odd", "inside"), "json-pieces")
    deep = sums_before(known, AT, "block", ["seq"], {"depth": F.col("step")})
    counted = sums_before(deep, AT, "block", ["seq"], {"record": (F.col("depth") + F.col("step") == 0).cast("long")})
    records = joined_records(counted.where("depth + step >= 0"), "}")
    return records.withColumn("value", F.concat(F.regexp_replace("value", r"^[\x{FEFF}\[,\s]+", ""), F.lit("}")))


def read_json_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON arrays. Objects are stored one per line, then read and typed by Spark's own reader."""
    lines = shared_dir(spark, "json-lines")
    json_records(spark, path).select(F.regexp_replace("value", "[\r\n]+", " ").alias("value")).write.text(lines)
    return spark.read.json(lines)


def file_fingerprints(spark: SparkSession, path: str, fanout: int = FANOUT, folders: bool = False) -> DataFrame:
    """(path, lines, fingerprint): the root of a hash tree over each file's lines in order.

    It depends on the bytes and their order, not on the ranges the file was read in. A line is held in one
    cell; whether the last line ends with a line feed makes no difference. With ``folders`` the files of one folder are
    one text, in order of their names, and path is the folder.
    """
    lines = pieces(spark, path, "\n")
    if folders:
        lines = lines.withColumn("block", F.struct("path", "block")).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    placed = numbered(lines, AT, "block", ["seq"], "node")
    levels = tree(placed.select("path", "node", leaf(["value"]).alias("digest")), AT, fanout)
    count = levels[0].groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    return count.join(levels[-1].select("path", F.col("digest").alias("fingerprint")), "path")
