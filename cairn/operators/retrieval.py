"""Hybrid retrieval in batch [2-L, C1, C2, E8, F1-F5, G1, G2, J11, J12]: every query of a set at once.

The access predicate is part of both scans. Ranks are per query, so the windows are partitioned by it and Spark limits
each group before the shuffle's end. Query sets are small next to the corpus only by contract, not by nature: they are
never broadcast by a hint, the planner does it where their measured size allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import scores
from cairn.functions.access import Principal
from cairn.functions.text import query_terms
from cairn.sources import shared


def top(rows: DataFrame, k: int, score: str = "score", key: str = "chunk_id", by: str = "query_id") -> DataFrame:
    """The k best of each query, ranked; equal scores by key [F1, F2, E8]."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


SHARD_ROWS = 65_536
_PACK = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("confidence", pa.binary()), ("unit", pa.binary())])
_HITS = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("mean_confidence", pa.float64()), ("score", pa.float64())])


def _packed(rows: DataFrame, key: str, vec: str, parts: int, block: int) -> DataFrame:
    """Rows of key, vec, mean_confidence as blocks of unit vectors, one binary each; vectors of no length are zeros."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        part = table.column("part")[0].as_py()
        for lo in range(0, table.num_rows, block):
            t = table.slice(lo, block).combine_chunks()
            x = np.array(t.column(vec).to_pylist(), np.float64)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            out.append((part, t.column(key).to_numpy().astype(np.int64).tobytes(), t.column("mean_confidence").to_numpy().astype(np.float64).tobytes(), unit.tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACK, strict=True)], schema=_PACK)

    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    return rows.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(part, key, vec, "mean_confidence").groupBy("part").applyInArrow(run, "part int, ids binary, confidence binary, unit binary")


def dense(queries: DataFrame, vectors: DataFrame, who: Principal | None = None, k: int = 40, digits: int = 10) -> DataFrame:
    """Cosine top-k of each query (query_id, q) over vectors (chunk_id, vec, access columns), all of one width [L2, F2].
    Vectors are dealt into shards of about SHARD_ROWS, as many as the session has shuffle partitions at least, and packed
    into blocks; every block of queries meets every shard by an equality on the shard, and a task multiplies two matrices and keeps k for each query,
    so what is shuffled is blocks and k hits a shard, never pairs. The join is a sorted one: the blocks of queries are small
    before they are dealt to every shard and many times that after, which is when a broadcast would take them to the driver."""
    seen = vectors.where(who.predicate()) if who else vectors
    shards = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-seen.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // 1024))
    asked = _packed(queries.withColumn("mean_confidence", F.lit(0.0)), "query_id", "q", blocks, 1024).select(F.col("ids").alias("q_ids"), F.col("unit").alias("q_unit"))
    held = _packed(seen, "chunk_id", "vec", shards, 16384)
    pairs = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(held.hint("merge"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qs, ids, confidence = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["confidence"], np.float64)
                q, v = (np.frombuffer(r[n], np.float64).reshape(len(i), -1) for n, i in (("q_unit", qs), ("unit", ids)))
                out = []
                for i, s in zip(qs, np.round(q @ v.T, digits), strict=True):
                    worst = np.partition(-s, k - 1)[k - 1] if len(s) > k else np.nan
                    near = np.flatnonzero(-s <= worst) if worst == worst else np.arange(len(s))
                    top_ = near[np.lexsort((ids[near], -s[near]))[:k]]
                    out.append((np.full(len(top_), i), ids[top_], confidence[top_], s[top_]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), _HITS, strict=True)], schema=_HITS)

    return top(pairs.mapInArrow(run, "query_id bigint, chunk_id bigint, mean_confidence double, score double"), k)


def query_lexemes(queries: DataFrame) -> DataFrame:
    """query_id, term: the lower-cased search terms of each query, once each [H1]."""
    return queries.select("query_id", F.explode(F.array_distinct(F.transform(query_terms(F.col("text")), F.lower))).alias("term"))


def postings(chunks: DataFrame, terms: DataFrame | None = None, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """term, key, tf and mean_confidence: the inverted index of the chunks given [H2, L3]. For a few queries at a time, the
    terms that they ask for: other tokens are then dropped before anything is shuffled. To keep, write it once for all terms,
    with the access columns, bucketed by term."""
    tokens = chunks.select(key, "mean_confidence", F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{1,4}-\d{1,5}[a-z]?|[a-z0-9]+"), F.lit(0))).alias("term"))
    if terms is not None:
        tokens = tokens.join(terms.select("term").distinct(), "term", "left_semi")
    return tokens.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("mean_confidence").alias("mean_confidence"))


def sparse(queries: DataFrame, chunks: DataFrame, who: Principal | None = None, k: int = 40) -> DataFrame:
    """Any-term search over chunks, the best k of each query [L3, L4, F1]. queries: query_id, text. The predicate is part of
    the scan: what a principal may not see is not tokenised. The rank is cover density, which for an any-term query is a
    tenth for each position of a term: each is a cover of its own, of one word. Queries of the same text are one search, whose
    hits go to all of them; a query in several rows asks for the words of all."""
    asked = queries.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    once = asked.groupBy("text").agg(F.min("query_id").alias("asker"))
    terms = query_lexemes(once.select(F.col("asker").alias("query_id"), "text"))
    index = postings(chunks.where(who.predicate()) if who else chunks, terms)
    hits = index.join(terms, "term").groupBy("query_id", "chunk_id").agg((F.sum("tf") * F.lit(0.1)).alias("score"), F.first("mean_confidence").alias("mean_confidence"))
    found = top(hits, k).withColumnRenamed("query_id", "asker")
    return asked.join(once, "text").select("query_id", "asker").join(found, "asker").drop("asker")


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 60, dense_weight: float = 1.0, sparse_weight: float = 0.8, limit: int | None = None, penalty: bool = True) -> DataFrame:
    """Reciprocal rank fusion with the confidence penalty [G1, J11, J12, F3-F5, C2]: query_id, chunk_id, score, method,
    ranks. The dense row's columns win where both have a chunk."""
    each = dense_hits.select("query_id", "chunk_id", "mean_confidence", "rank", F.lit("dense").alias("method"), F.lit(dense_weight).alias("w")).unionByName(
        sparse_hits.select("query_id", "chunk_id", "mean_confidence", "rank", F.lit("sparse").alias("method"), F.lit(sparse_weight).alias("w"))
    )
    fused = each.groupBy("query_id", "chunk_id").agg(
        F.sum(scores.rank_fusion(F.col("rank"), F.col("w"), k)).alias("raw"),
        F.min_by("mean_confidence", "method").alias("mean_confidence"),
        F.when(F.count(F.lit(1)) > 1, "hybrid").otherwise(F.min("method")).alias("method"),
        F.max(F.when(F.col("method") == "dense", F.col("rank"))).alias("dense_rank"),
        F.max(F.when(F.col("method") == "sparse", F.col("rank"))).alias("sparse_rank"),
    )
    score = scores.confidence_penalty(F.col("raw"), F.col("mean_confidence")) if penalty else F.col("raw")
    out = fused.withColumn("score", F.round(score, 10)).drop("raw")
    return top(out, limit) if limit else out


PROBE_BYTES = 8_000_000


def passages(chunks: DataFrame, probes: DataFrame) -> DataFrame:
    """chunk_id, probe_id: the probes (probe_id bigint, probe) that a chunk's text contains whole [C11]. Probes are a set of
    queries: they go in blocks of PROBE_BYTES, each an automaton in every task that the texts pass by once; no text is
    shuffled and no pair looked at. Null and empty probes are in no text."""
    rows = probes.where(F.col("probe") != "").select("probe_id", "probe", F.octet_length("probe").alias("bytes"))
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    blocks = 1 + size // PROBE_BYTES
    found = None
    for k in range(blocks):
        block = [(r["probe_id"], r["probe"]) for r in rows.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == k).toLocalIterator()]
        one = chunks.select("chunk_id", "text").mapInArrow(_containing(block), "chunk_id bigint, probe_id bigint")
        found = one if found is None else found.unionByName(one)
    return found


def _containing(block: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list[int]] = {}
        for i, p in block:
            ids.setdefault(p, []).append(i)
        machine = ahocorasick.Automaton()
        for p in ids:
            machine.add_word(p, p)
        machine.make_automaton()
        for b in batches:
            out = [(i, k) for i, text in zip(b.column("chunk_id").to_pylist(), b.column("text").to_pylist(), strict=True) if text and ids for p in {p for _, p in machine.iter(text)} for k in ids[p]]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.int64()) for n in (0, 1)], names=["chunk_id", "probe_id"])

    return run


def merge_evidence(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Union that keeps each key's best score; of equal ones the earlier [G2, F9, M12]."""
    both = existing.withColumn("__old", F.lit(1)).unionByName(incoming.withColumn("__old", F.lit(0)))
    cols = [c for c in existing.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct("score", "__old")).alias("b")
    return both.groupBy(key).agg(best).select(key, *[F.col(f"b.{c}").alias(c) for c in cols])


def evidence_graph(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (documents with their passages) and edges (query to passage, weighted by the best score) [L13, D32, J24]."""
    w = Window.partitionBy("query_id")
    edges = hits.withColumn("weight", F.round(scores.edge_weight(F.col("score"), F.max("score").over(w)), 6)).select("query_id", "chunk_id", "weight")
    nodes = hits.groupBy("query_id", "doc_type").agg(F.count(F.lit(1)).alias("passages"), F.bool_or(F.col("cited")).alias("cited"))
    return nodes, edges


def until_sufficient(queries: DataFrame, passes: list[Callable[[DataFrame], DataFrame]], enough: int = 3, k: int = 8) -> DataFrame:
    """Evidence for each query from as many passes as it takes, and no more [M12, G2]: a pass searches only the queries that have
    fewer than enough different passages so far; what it finds is added, a passage that is found again keeping its best score.
    query_id, pass_no (the last one that the query took part in), chunk_id, score, rank of the k best. A pass takes queries (query_id and what it
    needs) and gives query_id, chunk_id, score. Between passes the open queries and what was found are tables in the shared
    folder, so no search runs twice; once no query is open the passes that are left are not run."""
    open_, found = queries.withColumn("pass_no", F.lit(0)), None
    seen = shared.kept(queries.select("query_id").distinct().withColumn("pass_no", F.lit(0)), "asked")
    for n, search in enumerate(passes, 1):
        hits = search(open_.drop("pass_no")).select("query_id", "chunk_id", "score")
        both = hits if found is None else found.unionByName(hits)
        found = shared.kept(both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), "evidence")
        asked = open_.select("query_id").distinct().withColumn("pass_no", F.lit(n))
        seen = shared.kept(seen.unionByName(asked).groupBy("query_id").agg(F.max("pass_no").alias("pass_no")), "passes")
        have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= enough)
        open_ = shared.kept(queries.join(have.select("query_id"), "query_id", "left_anti").withColumn("pass_no", F.lit(n)), "open")
        if open_.isEmpty():
            break
    return top(found.join(seen, "query_id"), k).select("query_id", "pass_no", "chunk_id", "score", "rank")
