"""Filter interaction audit by adjacent transpositions [operator 12].

What a chain of filters removes at each step, for every order of the filters, follows from how many documents fail which
of them: one cell for each part and failure mask. Documents are read once, reduced to cells, and all orders are visited
by single swaps of neighbours (Steinhaus, Johnson and Trotter's walk): a swap leaves the steps before and behind it as they
are, so only two steps are counted anew. A filter's removals are added up on the way: its Shapley value times the number
of orders.

A to D look at one text. E (identical to the text of any smaller doc_id) is found without bringing copies together: the
smallest id of each text is an aggregate, reduced before anything is sent, and meets the rows by text and id at once, a key
that only repeated rows share, which are one counted row by then. Texts are compared by 128-bit hashes.

Cases: a null text is empty, and all empty texts are identical; a null id is smaller than none, and fails E never; repeated
rows are documents of their own (of an equal id, none is smaller); a document with several labels has what any of them says,
one without has neither; a null part is the empty string; an empty table gives no rows; other columns pass by; texts are read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batch, frugal, materialise

FILTERS = "ABCDE"
#: A: fewer words; B: fewer distinct words in a hundred; C: more capitals in a hundred code points; D: any of these.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_SEEN = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("text_hash", pa.binary()), ("mask", pa.int32())])


def failures(text: str) -> int:
    """Bits 0 to 3: whether A to D fail."""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (len(ws) < MIN_WORDS)
        | (100 * len(set(ws)) < MIN_DISTINCT * len(ws)) << 1
        | (100 * capitals > MAX_CAPITALS * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def seen(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, text_hash and the mask of A to D, a row for each document."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            hashes = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield batch(_SEEN, [b.column("doc_id"), b.column("part"), hashes, [int(failures(t)) for t in texts]])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, part string, text_hash binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask (bit k: the k-th filter fails), and how many documents there are, good ones and toxic ones."""
    rows = materialise(seen(frugal(docs), part).groupBy("text_hash", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audited")
    first = rows.where("doc_id IS NOT NULL").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    e = F.lit(1 << FILTERS.index("E"))
    known = rows.where("doc_id IS NOT NULL").join(first, ["text_hash", "doc_id"], "left").select("doc_id", "part", F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask") + e).alias("mask"), "n")
    known = known.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    said = said.where("doc_id IS NOT NULL AND (good OR toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    counted = known.join(said, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    counted = counted.union(rows.where("doc_id IS NULL").select("part", "mask", "n", F.lit(False), F.lit(False)))
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """The places k, one after the other, at which swapping the k-th and the next leads through all orders of n things: the
    last thing sweeps to and fro, and between two sweeps the others go one swap on."""
    if n < 2:
        return
    others, down = swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        k = next(others, None)
        if k is None:
            return
        yield k + down
        down = not down


def walk(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, names: str = FILTERS) -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders as visited, and the counts of each (part, order, step) from cells of the shape (part, mask)."""
    width, masks = len(names), np.arange(1 << len(names))
    fails = [n[:, (masks >> f & 1).astype(bool)].sum(axis=1) for f in range(width)]
    order = list(range(width))

    def removed(step: int) -> list[np.ndarray]:
        before = sum(1 << f for f in order[:step])
        at = (masks & before == 0) & (masks >> order[step] & 1).astype(bool)
        return [x[:, at].sum(axis=1) for x in (n, good, toxic)]

    steps = [removed(k) for k in range(width)]
    kept = n.sum(axis=1)[:, None] - np.cumsum([s[0] for s in steps], axis=0).T
    orders, out, total = [], {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}, np.zeros((len(n), width), np.int64)
    path = swaps(width)
    while True:
        orders.append("".join(names[f] for f in order))
        for c, x in (
            ("kept", kept.copy()),
            ("removed", np.stack([s[0] for s in steps], 1)),
            ("redundant", np.stack([fails[f] - s[0] for f, s in zip(order, steps, strict=True)], 1)),
            ("unique_fails", np.stack([n[:, 1 << f] for f in order], 1)),
            ("good_lost", np.stack([s[1] for s in steps], 1)),
            ("toxic_lost", np.stack([s[2] for s in steps], 1)),
        ):
            out[c].append(x)
        for f, s in zip(order, steps, strict=True):
            total[:, f] += s[0]
        k = next(path, None)
        if k is None:
            break
        order[k], order[k + 1] = order[k + 1], order[k]
        steps[k], steps[k + 1] = removed(k), removed(k + 1)
        # what both steps leave is the same in either order
        kept[:, k] = kept[:, k + 1] + steps[k + 1][0]
    counts = {c: np.stack(x, 1) for c, x in out.items()}
    counts["shapley"] = total[:, [[names.index(f) for f in o] for o in orders]]
    return orders, counts


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_OUT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(c, pa.int64()) for c in _COUNTS])


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step (columns doc_id, text and part of docs; doc_id, quality and toxic
    of labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 64):
                rows = b.slice(s, 64).to_pylist()
                table = np.zeros((3, len(rows), 1 << len(FILTERS)), np.int64)
                for k, r in enumerate(rows):
                    for c in r["cells"]:
                        table[:, k, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, counts = walk(*table)
                each = len(orders) * len(FILTERS)
                yield batch(
                    _OUT,
                    [
                        [r["part"] for r in rows for _ in range(each)],
                        [o for o in orders for _ in FILTERS] * len(rows),
                        np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders) * len(rows)),
                        *(counts[c].reshape(-1) for c in _COUNTS),
                    ],
                )

    whole = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return whole.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COUNTS))
