"""MinHash near-duplicates by an LSH forest [operator 8].

Documents with equal shingle sets form a class. Each class has a signature for every tree of the forest, a string of
minimum hashes; the trees' signatures are sorted over the cluster (a range partitioning, so a large group of like
signatures is spread), and neighbours in an order whose longest common prefix reaches the least depth are candidates.
Where more than REGION neighbours chain up, they are cut at longer prefixes into the groups that are compared first; all
of them stay candidates of one another. Candidates' components
are found and compared in full: small ones in one piece, each text sent once; of large ones first the runs of sorted
neighbours, for every tree, which join most of a group, then, block by block, every pair of texts that these links have
not joined and whose numbers of shingles let them reach the threshold. Links are confirmed on the full sets of 64-bit shingle hashes, and the confirmed links'
components are the result. Links and components stay in the cluster.

With 16 trees of least depth 4, a pair is missed by all trees with probability 8e-6 at similarity 0.85, 2e-4 at 0.80.

Cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words has its whole sequence
as one shingle; ids may be repeated (such rows are documents of their own with one id; equal rows share everything) or
null (a null never is a component's least id; a component of null ids has a null component_id and is kept); an empty
table gives no rows; other columns are ignored by components() and kept by deduplicate(); texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import batch, frugal, materialise, partitions, release, shingles, unused, WordHash, words
from cairn.llm.components import components as connected
from cairn.llm.components import spread_join, with_totals

TREES, LEAST, MOST = 16, 4, 7
REGION, GROUP, GROUP_BYTES = 4096, 128, 4_000_000
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 2**63, TREES * MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "doc_id bigint, th bigint, n_shingles bigint, s binary, size bigint, sig binary"
_SIGNED_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("s", pa.binary()), ("size", pa.int64()), ("sig", pa.binary())])


def signature(sh: np.ndarray) -> bytes:
    """TREES x MOST minimum hashes of 32 bits, big-endian, so that bytes sort as numbers."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(sh), 4096):
        low = np.minimum(low, np.multiply.outer(_FACTORS, sh[k : k + 4096]).min(axis=1))
    return (low >> np.uint64(32)).astype(">u4").tobytes()


_hashes: list[WordHash] = []


def _hash() -> WordHash:
    if not _hashes:
        _hashes.append(WordHash())
    return _hashes[0]


def signed(docs: DataFrame, n: int) -> DataFrame:
    """Each row's id, text hash, number of shingles, digest of the set (null: no shingles), size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _hash()
        for b in batches:
            count, digest, size, sig = [], [], [], []
            for text in b.column("text").to_pylist():
                sh = shingles(of.array(words(text)), n)
                count.append(len(sh))
                size.append(len(text) if text else 0)
                digest.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                sig.append(signature(sh) if len(sh) else None)
            yield batch(_SIGNED_OUT, [b.column("doc_id"), b.column("th"), count, digest, size, sig])

    return docs.mapInArrow(run, _SIGNED)


_PAIRS = "kind int, a binary, b binary, g bigint, tree int, prefix binary, pid bigint"
_PAIRS_OUT = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("g", pa.int64()), ("tree", pa.int32()), ("prefix", pa.binary()), ("pid", pa.int64())])


def _runs(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, lo, hi): row ranges [lo, hi) that chain up by common prefixes, and the first row of the run they are cut
    from; lcp[i] is that of rows i and i+1, LEAST at least to chain. A range of more than REGION rows is cut again at the
    next depth, until MOST; rows alone in such a cut are ranges too."""

    def cut(lo: int, hi: int, depth: int) -> Iterator[tuple[int, int, int]]:
        start = lo
        for i in range(lo, hi):
            if i == hi - 1 or lcp[i] < depth:
                first = start if depth == LEAST else lo
                if i + 1 - start > REGION and depth < MOST:
                    yield from ((first, a, b) for _, a, b in cut(start, i + 1, depth + 1))
                elif i > start or depth > LEAST:
                    yield first, start, i + 1
                start = i + 1

    yield from cut(0, len(lcp) + 1, LEAST)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, key, s) -> kind 0: each row b of a run with the run's first row a (of the least depth) and its group g of GROUP
    neighbours; kind 1: the partition's first and last row."""
    pid = TaskContext.get().partitionId()
    trees, keys, ids = [], [], []
    for b in batches:
        trees += b.column("tree").to_pylist()
        keys += b.column("key").to_pylist()
        ids += b.column("s").to_pylist()
    if not ids:
        return
    k = np.frombuffer(b"".join(keys), ">u4").reshape(len(ids), MOST)
    same = (k[1:] == k[:-1]) & (np.array(trees[1:]) == np.array(trees[:-1]))[:, None]
    lcp = np.where(same.all(axis=1), MOST, np.argmin(same, axis=1)).tolist() if len(ids) > 1 else []
    out = []
    for first, lo, hi in _runs(lcp):
        for i in range(lo, hi):
            out.append((0, ids[first], ids[i], pid << 32 | (lo + (i - lo) // GROUP * GROUP), trees[i], None, pid))
    for i, at in ((0, 0), (len(ids) - 1, 1)):
        out.append((1, ids[i], None, at, trees[i], keys[i][: 4 * LEAST], pid))
    for j in range(0, len(out), 20_000):
        yield batch(_PAIRS_OUT, list(zip(*out[j : j + 20_000], strict=True)))


_ORDER_OUT = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("s", pa.binary())])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = 4 * MOST
    for b in batches:
        sigs, ids = b.column("sig").to_pylist(), b.column("s").to_pylist()
        yield batch(_ORDER_OUT, [[t for _ in ids for t in range(TREES)], [s[w * t : w * (t + 1)] for s in sigs for t in range(TREES)], [i for i in ids for _ in range(TREES)]])


def confirmed(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of the sets: those pairs with den * |x & y| >= num * |x | y| that join what others do not."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    inter = np.zeros((n, n), np.float64)
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    step = max(1024, 8_000_000 // n)
    for lo in range(0, len(values), step):
        a, b = np.searchsorted(inverse, (lo, lo + step))
        m = np.zeros((n, min(step, len(values) - lo)), np.float32)
        m[row[a:b], inverse[a:b] - lo] = 1
        inter += m @ m.T
    inter = inter.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    x, y = np.nonzero(np.triu(den * inter >= num * union, 1))
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def _unjoined(member: DataFrame, joined: DataFrame, num: int, den: int) -> DataFrame:
    """s, g: the texts of those large components that the links so far (joined: v, c) leave in several clusters, in pairs
    of blocks. All but a component's largest cluster are compared with one another and with the largest. Blocks hold
    about GROUP texts, GROUP_BYTES characters and numbers of shingles that differ by less than den / num; only blocks
    of the same or neighbouring numbers meet, as no others can hold a link."""
    width = math.log(den / num) * (1 + 1e-9) if 0 < num < den else 0
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(width)) if width else F.col("n_shingles") if num >= den else F.lit(0)
    split = F.col("v").isNull()
    clusters = materialise(
        member.where("large").join(joined.withColumnRenamed("c", "k"), F.col("s") == F.col("v"), "left").select("s", "c", "size", band.cast("long").alias("band"), F.when(split, F.col("s")).otherwise(F.col("k")).alias("k")),
        "clusters",
    )
    main = clusters.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.max(F.struct("n", "k")).alias("top"), F.count(F.lit(1)).alias("clusters")).where("clusters > 1")
    rest = materialise(spread_join(clusters, main, ["c"], "s").select("s", "c", "size", "band", (F.col("k") != F.col("top.k")).alias("rest")), "unjoined")
    blocks = rest.groupBy("c", "band", "rest").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("size") / GROUP_BYTES)).cast("long").alias("nb"))
    cl = materialise(spread_join(rest, blocks, ["c", "band", "rest"], "s").select("s", "c", "band", "rest", F.pmod(F.xxhash64("s"), "nb").alias("no")), "blocks")
    at = cl.select("c", "band", "rest", "no").distinct()
    x = at.where("rest").select("c", F.col("band").alias("xb"), F.col("no").alias("xn"), F.explode(F.array(*(F.col("band") + F.lit(k) for k in ((-1, 0, 1) if width or num >= den else (0,))))).alias("band"))
    pairs = x.join(at, ["c", "band"]).where("NOT rest OR band > xb OR (band = xb AND no >= xn)").withColumn("g", F.xxhash64("c", "xb", "xn", "band", "rest", "no"))
    pairs = materialise(pairs, "meetings")
    sides = pairs.select("c", F.col("xb").alias("band"), F.lit(True).alias("rest"), F.col("xn").alias("no"), "g").union(pairs.select("c", "band", "rest", "no", "g")).distinct()
    out = materialise(cl.join(sides, ["c", "band", "rest", "no"]).select("s", "g"), "meet")
    release(clusters, rest, cl, pairs)
    return out


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and component_id of each row of docs (columns doc_id and text), linking
    documents with den * intersection >= num * union of their n-word shingle sets."""
    return _labelled(docs, n, num, den).select("doc_id", "th", "n_shingles", "component_id")


def _labelled(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of components(), and first: the least (id is null, doc_id, th) of a row's component, null without shingles."""
    spark = docs.sparkSession
    rows = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    sig = materialise(signed(rows, n), "signed")
    classes = materialise(
        sig.where("s IS NOT NULL").groupBy("s").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.max("size").alias("size"), F.max("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes"
    )
    parts = partitions(spark)
    order = classes.select("s", "sig").mapInArrow(_orders, "tree int, key binary, s binary").repartitionByRange(2 * parts, "tree", "key", "s").sortWithinPartitions("tree", "key", "s")
    near = materialise(order.mapInArrow(_neighbours, _PAIRS), "neighbours")
    # neighbours on either side of a partition's border
    w = Window.orderBy("pid", "g")
    edge = near.where("kind = 1").withColumn("next", F.lead(F.struct("tree", "prefix", F.col("a").alias("s"))).over(w))
    across = edge.where((F.col("g") == 1) & (F.col("next.tree") == F.col("tree")) & (F.col("next.prefix") == F.col("prefix"))).select("a", F.col("next.s").alias("b"))
    links = near.where("kind = 0").select("a", "b").union(across)
    whole = materialise(connected(links, "candidates").withColumnRenamed("v", "s").join(classes.select("s", "rep", "size", "n_shingles"), "s"), "members")
    large = (F.col("k") > GROUP) | (F.col("bytes") > GROUP_BYTES)
    member = materialise(with_totals(whole, "c", "s", {"k": (F.count(F.lit(1)), F.sum), "bytes": (F.sum("size"), F.sum)}).select("s", "rep", "c", "size", "n_shingles", large.alias("large")), "sized")
    text = materialise(
        member.select("s", "c", "large", F.col("rep.doc_id").alias("i"), F.col("rep.th").alias("t"))
        .hint("shuffle_hash")
        .join(rows, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")))
        .select("s", "c", "large", "text"),
        "texts",
    )
    by_tree = near.where("kind = 0").select(F.col("b").alias("s"), F.xxhash64("g", "tree").alias("g")).distinct()
    groups = text.where("NOT large").select(F.xxhash64("c").alias("g"), "s", "text").union(text.where("large").select("s", "text").join(by_tree, "s").select("g", "s", "text"))
    pair = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def confirm(table: pa.Table) -> pa.Table:
        of, sets = _hash(), {}
        for s, t in zip(table.column("s").to_pylist(), table.column("text").to_pylist(), strict=True):
            if s not in sets:
                sets[s] = shingles(of.array(words(t)), n)
        ids = sorted(sets)
        out = confirmed([sets[s] for s in ids], num, den) if len(ids) > 1 else []
        return pa.table([pa.array([ids[i] for i, _ in out], pa.binary()), pa.array([ids[j] for _, j in out], pa.binary())], schema=pair)

    def links_in(groups: DataFrame) -> DataFrame:
        return groups.groupBy("g").applyInArrow(confirm, "a binary, b binary").select("a", "b")

    joined = connected(links_in(groups), "links")
    more = _unjoined(member, joined, num, den)
    if not more.isEmpty():
        late = links_in(text.where("large").select("s", "text").join(more, "s").select("g", "s", "text"))
        joined = connected(joined.select(F.col("v").alias("a"), F.col("c").alias("b")).union(late), "links")
    least = joined.join(classes.select(F.col("s").alias("v"), "least", "first"), "v").select("v", "c", "least", "first")
    label = with_totals(least, "c", "v", {"component": (F.min("least"), F.min), "of": (F.min("first"), F.min)}).select(F.col("v").alias("s"), "component", "of")
    # a table of its own, so that the join below has exchanges on both sides and a large class of equal texts is split
    own = materialise(classes.select("s", "least", "first").join(label, "s", "left").select("s", F.coalesce("component", "least").alias("component_id"), F.coalesce("of", "first").alias("first")), "labels")
    release(classes, near, whole, member, text, more)
    with_set = sig.where("s IS NOT NULL").select("doc_id", "th", "n_shingles", "s").join(own, "s").select("doc_id", "th", "n_shingles", "component_id", "first")
    without = sig.where("s IS NULL").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast(with_set.schema["first"].dataType).alias("first"))
    return with_set.unionByName(without)


def deduplicate(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, one row of each component: that of the least id (nulls last), then the least text hash. Of rows
    equal in these the least by the other columns (those that have an order) stays. Rows without shingles are all kept."""
    rows = _labelled(docs, n, num, den).where("first IS NOT NULL")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    i, t, rank = (unused(docs, x) for x in ("id_", "text_hash", "rank_"))
    found = rows.groupBy(F.col("doc_id").alias(i), F.col("th").alias(t)).agg(F.count(F.lit(1)).alias("rows_of"), F.first(stays).alias("stays"))
    marks = materialise(found.where("NOT stays OR rows_of > 1"), "marks")
    of = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    once = docs.join(marks.select(i, t).hint("shuffle_hash"), of, "left_anti")
    again = marks.where("stays").select(i, t)
    if again.isEmpty():
        return once
    order = [F.col(f.name) for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "interval"))]
    w = Window.partitionBy(i, t).orderBy(*order)
    least = docs.join(again, of).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1)
    return once.unionByName(least.select(*docs.columns))
