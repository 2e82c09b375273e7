"""Table scans, and the adapters that read the tables as the engine's entities.

Derived columns are pure functions of the key, so a SQL statement can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sensitivity ladder, from the least to the most sensitive.
LADDER = ("public", "internal", "confidential", "restricted")
DEPARTMENTS = ("ops", "safety", "finance")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: tuple[str, ...], by) -> object:  # noqa: ANN001
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def with_access(rows: DataFrame, key: str) -> DataFrame:
    """Adds classification, departments and mean_confidence."""
    k = F.col(key)
    return rows.withColumns(
        {
            "classification": _pick(LADDER, k),
            "departments": F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_pick(DEPARTMENTS, k))),
            "mean_confidence": 0.5 + (k % 6) / 10.0,
        }
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as retrievable passages: chunk_id, text, doc_type and the access columns."""
    d = table(spark, sf_dir, "documents")
    return with_access(d.select(F.col("doc_id").alias("chunk_id"), "text", "lang", F.col("source").alias("doc_type"), "n_chars"), "chunk_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as passage vectors in double precision, with the access columns."""
    e = table(spark, sf_dir, "embeddings")
    return with_access(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"), "chunk_id")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an audit log: seq, ts, actor, action, decision, value, metadata."""
    return audit_from(table(spark, sf_dir, "events"))


def audit_from(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "deny").otherwise("allow").alias("decision"),
        "value",
        F.col("props").alias("metadata"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
