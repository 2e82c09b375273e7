"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents.

Quality rules drop documents; of each group of near copies one document stays; repeated byte strings are cut out of the
texts; live-looking secrets are masked; what is left is packed into token windows. All but the last stage return the
columns of documents, and each works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import near_dup, packing, quality, secrets, substring_dedup
from cairn.llm.common import materialise, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, all others stay as they are; nulls fail as empty texts do."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are 0.8 alike, by links, one row stays; documents without words stay."""
    return near_dup.deduplicate(docs, n=5, num=80, den=100)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 256 bytes or more that stand anywhere else too are cut out of all texts; a document whose text is all cut stays, empty."""
    return substring_dedup.remove_repeats(docs, substring_dedup.PASSAGE)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; values that several sources hold are examples and stay."""
    return secrets.redact(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that are left as pieces of sequences of at most 2048 tokens; a null or empty text is its end token alone."""
    return packing.pack(docs, capacity=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated substrings", repeated_substrings),
    ("secret scan", secret_scan),
    ("packing", packed_windows),
]
#: SQL cannot state tokenisation or suffix arrays; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
