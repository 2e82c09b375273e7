"""Exact top-k inner products by ball trees [operator 2].

Vectors are dealt into shards by a hash of their row; a ball tree is built for each shard and written to the shared
folder. Queries go in blocks. Each block first searches one shard, which gives every query a k-th score to beat, and
that score goes with the block to all others. Then shards are dealt out in runs, a task holds the trees of a run, and the
blocks pass by, each searching the run's trees one after the other and improving its k-th scores on the way. In a tree
the surviving (query, node) pairs go down level by level, bounded by q.c + |q| r, and each query takes the leaves in
order of that bound until it falls below its k-th score. What the runs return is merged by query.

Components are floor(64 x) as whole numbers, so scores are exact: in doubles while they stay below 2^53, else in
Python's integers. They are kept and sent in the narrowest type that holds them.

Cases: vectors null or with null or non-finite components, and null ids, take no part; a shorter vector counts as
filled up with zeros; rows that repeat an id are rows of their own, as queries (each gets its k best) and as candidates,
but no row with the query's id is its candidate; equal scores go to the smaller id; an empty table gives no rows; other
columns are ignored. A component of 2^57 or more in size, whose floor leaves 64 bits, and a score that does, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import batch, materialise, partitions
from cairn.llm.exchange import pack, unpack

SHARD, BLOCK, LEAF, RUN = 4096, 512, 128, 8
_HITS = "row bigint, query_id bigint, vec_id bigint, score bigint"
_OUT = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_TREE = "shard int, tree binary"
_TREE_OUT = pa.schema([("shard", pa.int32()), ("tree", pa.binary())])
_BLOCK = "block int, shard int, asked binary, found binary"
_BLOCK_OUT = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("asked", pa.binary()), ("found", pa.binary())])
EXACT = 2.0**53
Best = list[tuple[np.ndarray, np.ndarray]]


def quantised(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """row (a number), vec_id and v: floor(64 x) of each component, of the vectors that take part. The rows' numbers
    stay only once the result is written."""
    x = F.col(col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    floors = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**57, F.floor(c * 64).cast("long")).otherwise(F.raise_error(F.lit("a component times 64 leaves 64 bits")).cast("long")))
    return vectors.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), floors.alias("v"))


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest signed type that holds them."""
    lo, hi = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


class BallTree:
    """Rows are split at the median along the direction of two far points. Nodes lie in arrays, level by level:
    centre, radius, first row, one past the last, left child (the right one follows it; 0: a leaf)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x = ids, x
        f = x.astype(np.float64)
        order = np.arange(len(ids))
        nodes, todo = [], [(0, len(ids))]
        for lo, hi in todo:
            rows = f[order[lo:hi]]
            c = rows.mean(axis=0)
            d = np.sqrt(((rows - c) ** 2).sum(axis=1))
            child = 0
            if hi - lo > leaf and d.max() > 0:
                a = rows[int(d.argmax())]
                b = rows[int(((rows - a) ** 2).sum(axis=1).argmax())]
                along = rows @ (b - a)
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(along, mid)]
                child = len(todo)
                todo += [(lo, lo + mid), (lo + mid, hi)]
            nodes.append((c, float(d.max()) if len(d) else 0.0, lo, hi, child))
        self.ids, self.x, self.f = ids[order], narrow(x[order]), f[order]
        self.centre = np.array([n[0] for n in nodes])
        self.radius, self.lo, self.hi, self.child = (np.array([n[k] for n in nodes]) for k in (1, 2, 3, 4))

    def packed(self) -> bytes:
        return pack(self.ids, self.x, self.centre, self.radius, self.lo, self.hi, self.child)

    @classmethod
    def unpacked(cls, blob: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.ids, tree.x, tree.centre, tree.radius, tree.lo, tree.hi, tree.child = unpack(blob)
        tree.f = tree.x.astype(np.float64)
        return tree

    def search(self, q_ids: np.ndarray, q: np.ndarray, best: Best, k: int, least: np.ndarray) -> None:
        """best[i]: the i-th query's (scores, ids), both sorted by score, then id; it is improved by this tree's rows.
        least[i]: a score that k other rows are known to reach; lower ones are of no use."""
        f = q.astype(np.float64)
        norm = np.sqrt((f**2).sum(axis=1))
        exact = float(np.abs(f).max(initial=0)) * float(np.abs(self.f).max(initial=0)) * max(1, f.shape[1]) < EXACT
        kth = np.maximum(least, np.nextafter(kth_scores(best, k), -np.inf))
        slack = 1e-9 * (1 + np.abs(self.centre).max(initial=0) + self.radius.max(initial=0)) * (1 + norm.max(initial=0)) * max(1, f.shape[1])
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        above = np.full(len(q), np.inf)
        leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            bound = np.minimum(above, np.einsum("ij,ij->i", f[who], self.centre[node]) + norm[who] * self.radius[node] + slack)
            live = bound >= kth[who]
            who, node, bound = who[live], node[live], bound[live]
            last = self.child[node] == 0
            leaves.append((who[last], node[last], bound[last]))
            who, node, above = np.repeat(who[~last], 2), np.repeat(self.child[node[~last]], 2), np.repeat(bound[~last], 2)
            node[1::2] += 1
        who, node, bound = (np.concatenate(x) for x in zip(*leaves, strict=True))
        order = np.lexsort((node, -bound, who))
        who, node, bound = who[order], node[order], bound[order]
        first = np.searchsorted(who, np.arange(len(q) + 1))
        turn = 0
        while True:
            at = first[:-1] + turn
            open_ = at < first[1:]
            at = at[open_]
            at = at[bound[at] >= kth[who[at]]]  # a query whose next bound is too low is done: all later are lower
            if not len(at):
                return
            by = np.argsort(node[at], kind="stable")
            at = at[by]
            cuts = np.flatnonzero(np.diff(node[at])) + 1
            for group in np.split(at, cuts):
                lo, hi = self.lo[node[group[0]]], self.hi[node[group[0]]]
                qs = who[group]
                if exact:
                    s = (f[qs] @ self.f[lo:hi].T).astype(np.int64)
                else:
                    s = q[qs].astype(np.int64).astype(object) @ self.x[lo:hi].astype(np.int64).astype(object).T
                for i, row in zip(qs, s, strict=True):
                    keep = np.flatnonzero((row >= kth[i]) & (self.ids[lo:hi] != q_ids[i]))
                    if not len(keep):
                        continue
                    scores = np.concatenate([best[i][0], row[keep]])
                    ids = np.concatenate([best[i][1], self.ids[lo:hi][keep]])
                    top = np.lexsort((ids, -scores))[:k] if exact else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k])
                    best[i] = (scores[top], ids[top])
                    if len(top) >= k:
                        kth[i] = max(kth[i], np.nextafter(float(scores[top][-1]), -np.inf))
            turn += 1


def kth_scores(best: Best, k: int) -> np.ndarray:
    """Each query's k-th score so far, minus infinity before there are k."""
    return np.array([float(b[0][k - 1]) if len(b[0]) >= k else -np.inf for b in best], np.float64)


def _none(n: int) -> Best:
    return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]


def _rows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and vectors (filled up with zeros), by row number."""
    rows, ids, lists = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), table.column("v").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(ids), width), np.int64)
    at = np.repeat(np.arange(len(ids)), sizes)
    x[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(rows, kind="stable")
    return rows[order], ids[order], x[order]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", col: str = "embedding", shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row whose id is divisible by every."""
    v = materialise(quantised(vectors, id_col, col), "vectors")
    n, m, width = v.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("v"))).first()
    width = width or 0
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    # as many shards in a run as keep all partitions busy, RUN at most
    run = max(1, min(RUN, shards // partitions(vectors.sparkSession)))
    runs = -(-shards // run)
    h = F.xxhash64("row")

    def plant(table: pa.Table) -> pa.Table:
        _, ids, x = _rows(table, width)
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([BallTree(ids, x).packed()], pa.binary())], schema=_TREE_OUT)

    def gather(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows, ids, x = _rows(table, width)
        return pa.table([pa.array(c, f.type) for c, f in zip([[block], [block % shards], [pack(rows, ids, narrow(x))], [None]], _BLOCK_OUT, strict=True)], schema=_BLOCK_OUT)

    trees = materialise(v.withColumn("shard", F.pmod(h, F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(plant, _TREE), "trees")
    asked = v.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(h, F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(gather, _BLOCK)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's first shard: its k-th scores go into asked, the hits into found."""
        for b in batches:
            for r in b.to_pylist():
                rows, ids, q = unpack(r["asked"])
                best = _none(len(ids))
                BallTree.unpacked(r["tree"]).search(ids, q, best, k, np.full(len(ids), -np.inf))
                yield batch(_BLOCK_OUT, [[r["block"]], [r["shard"]], [pack(rows, ids, q, np.nextafter(kth_scores(best, k), -np.inf))], [pack(best)]])

    begun = materialise(asked.join(trees, "shard").select("block", "shard", "asked", "tree").mapInArrow(begin, _BLOCK), "begun")
    at = F.col("shard") / run
    meet = (
        trees.select(F.floor(at).cast("int").alias("run"), F.lit(0).alias("kind"), "shard", F.col("tree").alias("blob"), F.lit(None).cast("binary").alias("found"))
        .union(
            begun.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "block", "shard", "asked", "found")
            .select("run", (F.col("block") + 1).alias("kind"), "shard", F.col("asked"), F.when(F.floor(at) == F.col("run"), F.col("found")))
        )
        .repartition(runs, "run")
        .sortWithinPartitions("run", "kind", "shard")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, {}
        for b in batches:
            for r in b.to_pylist():
                if r["run"] != now:
                    now, held = r["run"], {}
                if not r["kind"]:
                    held[r["shard"]] = BallTree.unpacked(r["blob"])
                    continue
                rows, ids, q, least = unpack(r["blob"])
                best = unpack(r["found"])[0] if r["found"] else _none(len(ids))
                for shard, tree in held.items():
                    if shard != r["shard"]:
                        tree.search(ids, q, best, k, least)
                n = [len(x[0]) for x in best]
                yield batch(_OUT, [np.repeat(rows, n), np.repeat(ids, n), np.concatenate([x[1] for x in best]), [int(s) for x in best for s in x[0]]])

    hits = meet.mapInArrow(search, _HITS)
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
