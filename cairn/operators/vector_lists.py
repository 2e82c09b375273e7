"""An inverted-list index of vectors with residual codes [L2, A33, A35].

Vectors are dealt to the nearest of a set of centroids, clustered from a bounded sample (SAMPLE rows by a hash of the key);
every vector is indexed. A row keeps what its unit vector is beyond the centroid in one byte a component, beside the vector
itself and the columns of the access predicate. A search looks at the lists whose centroids are nearest to the query, in
their codes alone, keeps the `again` best of each query, and ranks these anew by their vectors.

How many lists must be looked at is measured when the index is written: ASKED different vectors of the sample are searched by brute
force over all vectors, and the number is the least that holds the share `recall` of what they find. It is kept with the
index, so well clustered vectors cost few lists and spread ones many.

The access predicate is part of the scan of the codes, before anything is ranked. Lists lie in folders by group and a large
one is spread over as many files as its size asks for. Queries go in blocks of BLOCK, each a broadcast of that many vectors;
a task keeps the best of each query, so what is shuffled is those, never pairs.

Cases: rows with a null key or vector are not indexed; vectors of no length score 0; all are of one width (else an error);
equal scores go to the smaller key; repeated rows are rows of their own; fewer rows than k are all found, if in lists looked
at; an empty table gives an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.access import Principal
from cairn.operators.retrieval import dense, top

SAMPLE, ASKED, BLOCK, GROUPS, MOST_LISTS = 16_384, 256, 4096, 256, 1024
_CODED = "list int, chunk_id bigint, code binary, vec array<double>, classification string, departments array<string>, mean_confidence double"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if len(column) and (column.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError(f"vectors of another width than {width}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def centroids(sample: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """n unit vectors: spherical clustering from evenly spaced rows of the sample; an empty cluster takes the row that is
    farthest from its own."""
    out = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = sample @ out.T
        of = near.argmax(axis=1)
        order = np.argsort(of, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))
        sums = np.zeros_like(out)
        sums[of[order][heads]] = np.add.reduceat(sample[order], heads, axis=0)
        empty = np.setdiff1d(np.arange(n), of)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        out = _unit(sums)
    return out


class Lists:
    """What a search needs to know of an index: centroids, the size of a code's step for each component, and how many lists
    to look at."""

    def __init__(self, spark: SparkSession, path: str):
        facts = spark.read.schema("list int, centroid array<double>").parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids = np.array([r["centroid"] for r in facts if r["list"] >= 0], np.float64)
        self.step = np.array(next(r["centroid"] for r in facts if r["list"] == -1), np.float64)
        self.rows = spark.read.schema(f"{_CODED}, list_group int").parquet(f"{path}/rows")
        probes = spark.read.schema("probes int").parquet(f"{path}/probes").collect() if _there(spark, f"{path}/probes") else []
        self.probes = probes[0]["probes"] if probes else len(self.centroids)

    def nearest(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The lists of each query, the nearest first."""
        return np.argsort(-np.round(q @ self.centroids.T, 12), axis=1, kind="stable")[:, :probes]


def _there(spark: SparkSession, path: str) -> bool:
    from cairn.sources.shared import filesystem

    fs, p = filesystem(spark, path)
    return fs.exists(p)


def write_lists(vectors: DataFrame, path: str, k: int = 10, recall: float = 0.97) -> Lists:
    """The index of vectors (chunk_id, vec and the access columns), written to path and read back."""
    spark = vectors.sparkSession
    rows = vectors.where("chunk_id IS NOT NULL AND vec IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vec").cast("array<double>").alias("vec"), "classification", "departments", F.col("mean_confidence").cast("double").alias("mean_confidence"))
    n = rows.count()
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    taken = rows.where(share).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    width = len(taken[0]) if len(taken) else 1
    taken = _matrix(taken, width)
    sample = _unit(taken)
    lists = max(1, min(MOST_LISTS, 2 * int(n**0.5), len(sample)))
    centres = centroids(sample, lists) if len(sample) else np.zeros((1, width))
    rest = sample - centres[(sample @ centres.T).argmax(axis=1)]
    step = np.maximum(np.abs(rest).max(axis=0, initial=0.0), 1e-9) / 127
    facts = [(-1, step.tolist()), *((i, c.tolist()) for i, c in enumerate(centres))]
    spark.createDataFrame(facts, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unit(_matrix(b.column("vec"), width))
            of = (u @ centres.T).argmax(axis=1) if len(u) else np.zeros(0, np.int64)
            codes = np.clip(np.round((u - centres[of]) / step), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), b.column("chunk_id"), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("vec"), b.column("classification"), b.column("departments"), b.column("mean_confidence")], names=["list", "chunk_id", "code", "vec", "classification", "departments", "mean_confidence"])

    made = rows.mapInArrow(coded, _CODED).withColumn("list_group", F.pmod("list", F.lit(GROUPS)).cast("int"))
    made.hint("rebalance", "list_group").sortWithinPartitions("list_group", "list", "chunk_id").write.partitionBy("list_group").parquet(f"{path}/rows")
    index = Lists(spark, path)
    if len(taken):
        # copies of a vector ask once
        distinct = np.sort(np.unique(sample, axis=0, return_index=True)[1])[:ASKED]
        asked = spark.createDataFrame([(i, taken[j].tolist()) for i, j in enumerate(distinct)], "query_id bigint, q array<double>")
        truth = dense(asked, rows, k=k).join(index.rows.select("chunk_id", "list"), "chunk_id").select("query_id", "list").collect()
        place = np.argsort(index.nearest(sample[distinct], lists), axis=1)
        needed = np.sort([place[r["query_id"], r["list"]] + 1 for r in truth])
        index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    spark.createDataFrame([(index.probes,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    return index


_FOUND = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("chunk_id", pa.int64()), ("near", pa.float64())])


class _Best:
    """The best rows of each query in a task."""

    def __init__(self, keep: int):
        self.keep = keep
        self.rows: dict[int, list[np.ndarray]] = {}

    def add(self, q: int, near: np.ndarray, keys: np.ndarray, of: int) -> None:
        self.rows[q] = self._cut([np.concatenate(x) for x in zip(self.rows[q], (near, keys, np.full(len(keys), of)), strict=True)] if q in self.rows else [near, keys, np.full(len(keys), of)])

    def _cut(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        if len(rows[0]) <= self.keep:
            return rows
        order = np.lexsort((rows[1], -rows[0]))[: self.keep]
        return [x[order] for x in rows]


def _scan(index: Lists, ids: np.ndarray, q: np.ndarray, who: Principal | None, again: int, probes: int) -> DataFrame:
    """query_id, list, chunk_id and near: for each query what is best by the codes in its lists."""
    spark, near = index.rows.sparkSession, index.nearest(q, probes)
    asking: dict[int, np.ndarray] = {int(of): np.flatnonzero((near == of).any(axis=1)) for of in np.unique(near)}
    base = np.round(q @ index.centroids.T, 12)
    shared = spark.sparkContext.broadcast((ids, q * index.step, base, asking))
    rows = index.rows.where(F.col("list_group").isin(sorted({of % GROUPS for of in asking})))
    rows = rows.where(who.predicate()) if who else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scaled, base, asking = shared.value
        best = _Best(again)
        for b in batches:
            lists, keys = b.column("list").to_numpy(), b.column("chunk_id").to_numpy()
            codes = b.column("code").to_pylist()
            cuts = np.flatnonzero(np.diff(lists)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(lists)), strict=True):
                if hi == lo or int(lists[lo]) not in asking:
                    continue
                qs = asking[int(lists[lo])]
                c = np.frombuffer(b"".join(codes[lo:hi]), np.int8).reshape(hi - lo, -1).astype(np.float64)
                near = np.round(base[qs, lists[lo]][:, None] + scaled[qs] @ c.T, 10)
                for i, row in zip(qs, near, strict=True):
                    best.add(int(i), row, keys[lo:hi], int(lists[lo]))
        out = list(best.rows.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip(([np.full(len(r[0]), ids[i]) for i, r in out], [r[2] for _, r in out], [r[1] for _, r in out], [r[0] for _, r in out]), _FOUND, strict=True)], schema=_FOUND
        )

    return rows.select("list", "chunk_id", "code").mapInArrow(run, "query_id bigint, list int, chunk_id bigint, near double")


def search(queries: DataFrame, index: Lists, who: Principal | None = None, k: int = 10, again: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, mean_confidence, score (cosine to ten places) and rank of the k best of each query (query_id, q).
    again: rows of each query that are ranked by their vectors (ten times k)."""
    again, probes = again or 10 * k, probes or index.probes
    asked = queries.where("query_id IS NOT NULL AND q IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
    blocks = max(1, -(-asked.count() // BLOCK))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
        if rows:
            q = _unit(np.array([r["q"] for r in rows], np.float64))
            one = _scan(index, np.array([r["query_id"] for r in rows]), q, who, again, probes)
            found = one if found is None else found.union(one)
    if found is None:
        return asked.sparkSession.createDataFrame([], "query_id bigint, chunk_id bigint, mean_confidence double, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id")
    few = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= again).select("query_id", "list", "chunk_id").distinct()
    rows = index.rows.where(who.predicate()) if who else index.rows
    j = few.join(rows.select("list", "chunk_id", "vec", "mean_confidence"), ["list", "chunk_id"]).join(asked.dropDuplicates(["query_id"]), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("q", "q")) * F.sqrt(dot("vec", "vec"))
    return top(j.select("query_id", "chunk_id", "mean_confidence", F.when(norm > 0, F.round(dot("q", "vec") / norm, 10)).otherwise(F.lit(0.0)).alias("score")), k)
