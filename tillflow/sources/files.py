"""Reading files of several formats, with guards around names, delimiters and empty input."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import splits

DELIMITERS = [",", ";", "\t", "|"]
BOM = "\ufeff"
MAX_NAME = 128
CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")


class InputError(ValueError):
    """An input is missing, empty or breaks its contract."""


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text; quoted fields may span lines and double their quotes.

    Files longer than a split are read in byte ranges, as Spark's multi-line reader gives a file to one task.
    """
    if splits.largest_file(spark, path) > split_bytes(spark):
        return normalize_header(splits.read_csv_ranges(spark, path, delimiter))
    options = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8", "sep": delimiter}
    return normalize_header(spark.read.options(**options).csv(path))


def split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def normalize_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(BOM, "").strip() for c in df.columns])


def sanitize_names(names: list[str | None]) -> list[str]:
    """Names without control characters, blanks replaced, at most 128 characters, repeats numbered.

    A number that makes a taken name is passed over, and the name is cut to leave room for it. Names
    differ beyond their case, as Spark resolves columns without regard to it.
    """
    out: list[str] = []
    taken: set[str] = set()
    for position, name in enumerate(names, start=1):
        clean = CONTROL.sub("", (name or "").strip()).strip() or f"unnamed_column_{position}"
        free, number = clean[:MAX_NAME], 0
        while free.lower() in taken:
            number += 1
            suffix = f"_{number}"
            free = clean[: MAX_NAME - len(suffix)] + suffix
        taken.add(free.lower())
        out.append(free)
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitize_names(df.columns))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter whose count per line is positive and the same on most lines.

    All lines vote in one distributed count; the result has one row per (delimiter, count).
    """
    lines = spark.read.text(path).filter(F.length("value") > 0)
    votes = F.array(*[F.struct(F.lit(d).alias("d"), (F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias("n")) for d in DELIMITERS])
    counted = lines.select(F.explode(votes).alias("v")).select("v.*").filter(F.col("n") > 0).groupBy("d", "n").agg(F.count(F.lit(1)).alias("lines"))
    best = counted.orderBy(F.col("lines").desc(), F.col("n").desc(), F.col("d")).first()
    return best.d if best else DELIMITERS[0]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Read by suffix: csv (delimiter voted), parquet, json (lines or one array). Empty input raises."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif name.endswith((".csv", ".txt", ".tsv")):
        df = read_csv(spark, path, sniff_delimiter(spark, path))
    elif name.endswith((".jsonl", ".ndjson")):
        df = spark.read.json(path)
    elif name.endswith(".json"):
        start = F.substring(F.regexp_replace("value", r"^[\x{FEFF}\s]+", ""), 1, 1)
        first = spark.read.option("lineSep", "}").text(path).select(start.alias("c")).filter("c != ''").first()
        array = bool(first) and first.c == "["
        df = splits.read_json_ranges(spark, path) if array and splits.largest_file(spark, path) > split_bytes(spark) else spark.read.option("multiLine", array).json(path)
    else:
        raise InputError(f"unsupported file type: {path}")
    if not df.columns or df.isEmpty():
        raise InputError(f"no rows in {path}")
    return sanitize_columns(df)


def input_status(spark: SparkSession, path: str) -> str:
    """OK, MISSING, EMPTY_FILE or NO_ROWS of a delimited source."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return "MISSING"
    if fs.getContentSummary(root).getLength() == 0:
        return "EMPTY_FILE"
    return "NO_ROWS" if read_csv(spark, path).isEmpty() else "OK"


def guard(spark: SparkSession, paths: dict[str, str]) -> None:
    """Raise one error that names every unusable source."""
    bad = {name: status for name, path in paths.items() if (status := input_status(spark, path)) != "OK"}
    if bad:
        raise InputError("; ".join(f"{n}: {s}" for n, s in sorted(bad.items())))


def contract_rows(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    """One row per required column: present or not, and how many cells are filled. Extra columns pass."""
    entries = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c).alias("column"),
            F.lit(c in df.columns).alias("present"),
            (F.count(c) if c in df.columns else F.lit(0).cast("bigint")).alias("filled"),
        )
        for c in required
    ]
    return df.agg(F.array(*entries).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def require_columns(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise InputError(f"{table} lacks required columns: {', '.join(missing)}")
    return df


def fingerprint(df: DataFrame) -> DataFrame:
    """Content fingerprint that does not depend on row order: count, xor and sum of row hashes.

    The sum tells apart tables whose repeated rows cancel out under xor.
    """
    row = F.xxhash64(*df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(row).alias("hash_xor"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    ).withColumn("columns", F.lit(",".join(df.columns)))
