"""From raw documents to token ids: five stages over the documents table.

Every stage reads all rows that the stage before it kept; all but the last return the columns of documents.
Rejected, repeated and near-repeated documents go, the rest is mixed to the target weights of its sources
(a document that the mix takes twice is two rows), and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillflow.llm import exact_dedup, mixing, near_copies, piece_tokens, quality
from tillflow.llm.queries import documents, tokenizer_file
from tillflow.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: linked by fingerprints of five-word shingles, beyond their bits by minimum hashes."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_tokens.digests(docs, tokenizer_file("piece_bpe_32k.model"), forget=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", apply_quality_rules),
    ("exact_dedup", drop_equal_texts),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("piece_tokens", encode_pieces),
]

#: Similar texts, components and the tokenizer's merges have no plain SQL; the tests compare with loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows stored before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
