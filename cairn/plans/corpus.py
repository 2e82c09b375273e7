"""Queries of a published corpus: documents with their pages, blocks, passages and vectors, through several changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.publishing import Corpus
from cairn.plans.registry import query
from cairn.sources import shared, tables

TABLES = {
    "documents": "doc_id bigint, sha256 string, doc_type string, n_chars bigint, status string",
    "pages": "doc_id bigint, page_no int, text string",
    "blocks": "doc_id bigint, ord int, text string",
    "chunks": "doc_id bigint, chunk_id string, n_words int",
    "vectors": "doc_id bigint, chunk_id string, vec array<float>",
}
_PAGE = 2000


def _parts(docs: DataFrame, vectors: DataFrame, fault: bool = False) -> dict[str, DataFrame]:
    """What is published of documents: pages of _PAGE characters, blocks by line, a passage for each block of five words or
    more, and the vector that goes with the document."""
    text = F.coalesce("text", F.lit(""))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(text) / _PAGE).cast("int")))).alias("page_no"), text.alias("t"))
    blocks = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("ord", "text")).where("text <> ''")
    n = F.size(F.split("text", " "))
    chunks = blocks.select("doc_id", F.concat_ws(":", "doc_id", "ord").alias("chunk_id"), n.alias("n_words")).where("n_words >= 5")
    vec = F.col("embedding") if not fault else F.transform("embedding", lambda x: F.raise_error("no room for vectors").cast("float") + x)
    return {
        "documents": docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("source").alias("doc_type"), "n_chars", F.lit("ready").alias("status")),
        "pages": pages.select("doc_id", "page_no", F.expr(f"substring(t, 1 + (page_no - 1) * {_PAGE}, {_PAGE})").alias("text")),
        "blocks": blocks,
        "chunks": chunks,
        "vectors": docs.select("doc_id").join(vectors, F.col("doc_id") == F.col("vec_id")).select("doc_id", F.concat_ws(":", "doc_id", F.lit("v")).alias("chunk_id"), vec.alias("vec")),
    }


def _story(spark: SparkSession, d: str) -> Corpus:
    """Versions: 1 all documents but each third; a failed one, of which nothing stays; 2 the others; 3 each fifth deleted; 4
    each tenth published again, revised; 5 compacted."""
    docs, vectors = tables.table(spark, d, "documents"), tables.table(spark, d, "embeddings").select("vec_id", "embedding")
    corpus = Corpus(spark, shared.folder(spark, "corpus"), TABLES)
    corpus.publish(_parts(docs.where("doc_id % 3 <> 0"), vectors))
    try:
        corpus.publish(_parts(docs.where("doc_id % 3 = 0"), vectors, fault=True))
    except Exception as error:  # noqa: BLE001
        if "no room for vectors" not in str(error):
            raise
    corpus.publish(_parts(docs.where("doc_id % 3 = 0"), vectors))
    corpus.delete(docs.where("doc_id % 5 = 0").select("doc_id"))
    corpus.publish(_parts(docs.where("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit("\nrevised: read it again from the start"))), vectors))
    corpus.compact()
    return corpus


_NAMES = ("documents", "pages", "blocks", "chunks", "vectors")
_FACTS = """b AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (len(string_split(t, ' ')) >= 5) AS chunks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE t <> '' GROUP BY 1),
    f AS (SELECT doc_id, 1 AS documents, greatest(1, CAST(ceil(length(coalesce(text, '')) / 2000) AS BIGINT)) AS pages, coalesce(blocks, 0) AS blocks, coalesce(chunks, 0) AS chunks, (SELECT count(*) FROM embeddings WHERE vec_id = doc_id) AS vectors, text
          FROM documents LEFT JOIN b USING (doc_id))"""
_ALIVE = ("doc_id % 3 <> 0", "true", "doc_id % 5 <> 0", "doc_id % 5 <> 0 OR doc_id % 10 = 0", "doc_id % 5 <> 0 OR doc_id % 10 = 0")


_REVISED = """r AS (SELECT doc_id, documents, CASE WHEN doc_id % 10 = 0 THEN CAST(ceil((length(text) + 38) / 2000) AS BIGINT) ELSE pages END AS pages, CASE WHEN doc_id % 10 = 0 THEN blocks + 1 ELSE blocks END AS blocks,
      CASE WHEN doc_id % 10 = 0 THEN chunks + 1 ELSE chunks END AS chunks, vectors, CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'revised: read it again from the start' ELSE text END AS text FROM f)"""


@query(
    f"WITH {_FACTS}, {_REVISED} "
    + " UNION ALL ".join(f"SELECT {v} AS version, '{t}' AS name, CAST(coalesce(sum({t}), 0) AS BIGINT) AS n FROM {'f' if v < 4 else 'r'} WHERE {alive}" for v, alive in enumerate(_ALIVE, 1) for t in _NAMES)
)
def corpus_versions(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each table has at each version, a failed change among them"""
    corpus, out = _story(spark, d), None
    for version in range(1, corpus.version() + 1):
        for name in _NAMES:
            one = corpus.read(name, version).agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("version"), F.lit(name).alias("name"), "n")
            out = one if out is None else out.union(one)
    return out


@query(f"WITH {_FACTS}, {_REVISED} SELECT doc_id, sha256(text) AS sha256, pages, blocks, chunks, vectors FROM r WHERE {_ALIVE[-1]}")
def published_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document of the last version with what each table has of it"""
    corpus = _story(spark, d)
    out = corpus.read("documents").select("doc_id", "sha256")
    for name in _NAMES[1:]:
        out = out.join(corpus.read(name).groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left")
    return out.select("doc_id", "sha256", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in _NAMES[1:]])


