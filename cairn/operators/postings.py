"""A kept positional index for text search [H1, H2, L3, L4, C1].

write_index() tokenises each passage once. A task gathers the postings of FLUSH tokens and writes one row for each of their
terms: who has it and at which positions, as differences in variable-length bytes. Rows lie in folders by bucket of the term,
sorted by term, and a bucket that is large is spread over as many files as its size asks for, so a term of a third of all
passages is no one task's. Each posting names its access class (classification and departments), numbers of a table that
goes with the index. search() reads the buckets of the terms that are asked for, and of these the terms; postings of classes
that the principal may not see are dropped before anything is ranked.

The rank is cover density: a cover is a span that holds what the query asks for and in which no shorter one does; it
counts a tenth, divided by one more than the other words in it; ranks are rounded to six places. Under "any" each position
is a cover of its own; under "all" every term must be there; under "phrase" each at its distance from the first.

Words are lower-cased runs of letters or digits, or tags. With stems, words too common to search for are no terms but
still count as positions.

Cases: null and empty texts have no postings; a null key is no passage; a query without terms finds nothing; repeated passages
of one key are laid over each other (each position once, but under "any"); equal ranks go to the smaller key; a term asked for twice is asked
for once, but in a phrase.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.access import Principal
from cairn.functions.stems import stem
from cairn.functions.text import STOP_WORDS
from cairn.operators.retrieval import top
from cairn.sources import shared

TOKEN = r"[a-z]{1,4}-\d{1,5}[a-z]?|[a-z0-9]+"
BUCKETS = 256
#: Terms that a scan is given by name; beyond that it is given their buckets alone.
NAMED = 512
#: Tokens whose postings a task gathers; access classes that are numbered from 0 (more have hashes for numbers).
FLUSH, CLASSES = 1_000_000, 65_536
_WORDS = re.compile(TOKEN)
_STOP = frozenset(STOP_WORDS)
_SCHEMA = "term string, postings binary"
_POSTINGS = pa.schema([("term", pa.string()), ("postings", pa.binary())])


@functools.lru_cache(200_000)
def _stemmed(word: str) -> str:
    return "" if word in _STOP else stem(word)


def terms_of(text: str, stems: bool) -> list[str]:
    """The term at each position, empty for a word that is none."""
    words = _WORDS.findall(text.lower())
    return [*map(_stemmed, words)] if stems else words


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes of seven bits, the lowest first, all but a number's last with the top bit; and how many bytes
    each takes."""
    values = values.astype(np.uint64, copy=False)
    n = np.ones(len(values), np.int8)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        n += more
    ends = np.cumsum(n, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    # most numbers are one byte: each round looks at those that go on
    at, left, size = ends - n, values, n
    while len(left):
        out[at] = (left & np.uint64(127)).astype(np.uint8) | ((size > 1).astype(np.uint8) << 7)
        on = np.flatnonzero(size > 1)
        at, left, size = at[on] + 1, left[on] >> np.uint64(7), size[on] - 1
    return out, n


def _starts(b: np.ndarray) -> np.ndarray:
    """Where each number begins, and the end."""
    return np.concatenate((np.zeros(1, np.int64), np.flatnonzero(b < 128) + 1))


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    starts = _starts(b)
    k = np.arange(len(b)) - np.repeat(starts[:-1], np.diff(starts))
    return np.bitwise_or.reduceat((b & 127).astype(np.uint64) << (7 * k).astype(np.uint64), starts[:-1])


def _signed(x: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones that are small for small ones."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


class _Ids(dict):
    """Numbers for terms as they come."""

    def __missing__(self, term: str) -> int:
        n = self[term] = len(self)
        return n


class _Gathered:
    """Tokens of passages, until there are enough for their postings."""

    def __init__(self) -> None:
        self.ids = _Ids()
        self.keys: list[int] = []
        self.classes: list[int] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.n = 0

    def add(self, key: int, of: int, found: list[str]) -> None:
        self.keys.append(key)
        self.classes.append(of)
        self.lengths.append(len(found))
        self.terms.append(np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)))
        self.n += len(found)

    def postings(self) -> pa.RecordBatch:
        """A row for each term: for each passage that has it its class, the difference of its key to the one before, how often,
        and the differences of the positions."""
        keys, lengths = np.array(self.keys, np.int64), np.array(self.lengths, np.int64)
        term = np.concatenate([*self.terms, np.zeros(0, np.int32)])
        place = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        by_key = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[by_key] = np.arange(len(keys))
        passage = np.repeat(rank, lengths)
        if "" in self.ids:
            real = term != self.ids[""]
            term, place, passage = term[real], place[real], passage[real]
        order = np.lexsort((place, passage, term))
        term, place, passage = term[order], place[order], passage[order]
        first = np.ones(min(1, len(term)), bool)
        row = np.concatenate((first, term[1:] != term[:-1]))
        new = row | np.concatenate((first, passage[1:] != passage[:-1]))
        heads = np.flatnonzero(new)
        tf = np.diff(np.append(heads, len(term)))
        row_heads = row[heads]
        own = keys[by_key][passage[heads]]
        before = np.where(row_heads, 0, np.concatenate((np.zeros(min(1, len(own)), np.int64), own[:-1])))
        values = np.zeros(3 * len(heads) + len(term), np.uint64)
        at = heads + 3 * np.arange(len(heads))
        values[at] = _signed(np.array(self.classes, np.int64)[by_key][passage[heads]])
        with np.errstate(over="ignore"):
            values[at + 1] = _signed(own - before)
        values[at + 2] = tf
        gaps = place - np.where(new, 0, np.concatenate((np.zeros(min(1, len(place)), np.int64), place[:-1])))
        values[np.arange(len(term)) + 3 * np.cumsum(new)] = gaps
        data, sizes = packed(values)
        starts = np.append(at[row_heads], len(values))
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64))[starts]
        packs = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        names = pa.array(list(self.ids), pa.string()).take(pa.array(term[heads][row_heads]))
        return pa.RecordBatch.from_arrays([names, packs], schema=_POSTINGS)


def _gathered(batches: Iterator[pa.RecordBatch], stems: bool, flush: int) -> Iterator[pa.RecordBatch]:
    now = _Gathered()
    for b in batches:
        for key, of, text in zip(b.column("chunk_id").to_pylist(), b.column("class").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text:
                now.add(key, of, terms_of(text, stems))
            if now.n >= flush:
                done, now = now, _Gathered()
                yield done.postings()
    yield now.postings()


def postings(data: bytes, seen: Callable[[int], bool], places: bool) -> Iterator[tuple[int, int, int, bytes | None]]:
    """Class, key, how often and the packed positions, of the classes that are seen."""
    values = unpacked(data).tolist()
    starts = _starts(np.frombuffer(data, np.uint8)).tolist() if places else []
    h, key = 0, 0
    while h < len(values):
        of, step, tf = values[h : h + 3]
        of, key = (of >> 1) ^ -(of & 1), (key + ((step >> 1) ^ -(step & 1)) + (1 << 63)) % (1 << 64) - (1 << 63)
        if seen(of):
            yield of, key, tf, data[starts[h + 3] : starts[h + 3 + tf]] if places else None
        h += 3 + tf


def _class_key():  # noqa: ANN202
    return F.to_json(F.struct("classification", "departments"), {"ignoreNullFields": "false"})


def write_index(chunks: DataFrame, path: str, stems: bool = True, buckets: int = BUCKETS, flush: int = FLUSH) -> Index:
    """The index of chunks (chunk_id, text, classification, departments), written to path and read back."""
    rows = chunks.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("text").cast("string").alias("text"), _class_key().alias("class_key"), "classification", "departments")
    classes = rows.groupBy("class_key").agg(F.first("classification").alias("classification"), F.first("departments").alias("departments"))
    few = classes.select("class_key").limit(CLASSES + 1).collect()
    if len(few) <= CLASSES:
        numbers = chunks.sparkSession.createDataFrame(list(enumerate(sorted(r[0] for r in few))), "class bigint, class_key string")
        rows, classes = (t.join(F.broadcast(numbers), "class_key") for t in (rows, classes))
    else:
        rows, classes = (t.withColumn("class", F.xxhash64("class_key")) for t in (rows, classes))
    classes.select("class", "classification", "departments").write.parquet(f"{path}/classes")
    made = rows.select("chunk_id", "class", "text").mapInArrow(lambda b: _gathered(b, stems, flush), _SCHEMA).withColumn("bucket", _bucket(buckets))
    made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    return Index(chunks.sparkSession, path, stems, buckets)


class Index:
    """An index that was written, with stems and buckets as it was written."""

    def __init__(self, spark: SparkSession, path: str, stems: bool = True, buckets: int = BUCKETS):
        self.stems, self.buckets = stems, buckets
        self.rows = spark.read.schema(_SCHEMA + ", bucket int").parquet(f"{path}/postings")
        self.classes = spark.read.schema("class bigint, classification string, departments array<string>").parquet(f"{path}/classes")

    def found(self, terms: DataFrame, who: Principal | None, places: bool) -> DataFrame:
        """term, chunk_id, tf and packed positions of the visible postings of terms (term, bucket)."""
        rows = self.rows.where(F.col("bucket").isin([r["bucket"] for r in terms.select("bucket").distinct().collect()]))
        named = [r["term"] for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
        rows = rows.where(F.col("term").isin(named)) if len(named) <= NAMED else rows.join(terms.select("term").distinct(), "term", "left_semi")
        visible = self.classes.where(who.predicate()).select("class") if who else None
        few = visible.limit(CLASSES + 1).collect() if who else []
        seen = {r["class"] for r in few} if who and len(few) <= CLASSES else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = (lambda c: True) if seen is None else seen.__contains__
            for b in batches:
                for term, data in zip(b.column("term").to_pylist(), b.column("postings").to_pylist(), strict=True):
                    out = list(postings(data, test, places))
                    yield pa.RecordBatch.from_arrays([pa.array([term] * len(out), pa.string()), *(pa.array([x[k] for x in out], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.binary())))], names=["term", "class", "chunk_id", "tf", "positions"])

        out = rows.select("term", "postings").mapInArrow(run, "term string, class bigint, chunk_id bigint, tf bigint, positions binary")
        if who and seen is None:
            out = out.join(visible, "class", "left_semi")
        return out.drop("class")


def _bucket(buckets: int):  # noqa: ANN202
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _asked(queries: DataFrame, stems: bool, phrase: bool) -> DataFrame:
    """query_id, slot, term: what each query asks for; the slots of a phrase are distances from its first term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b.column("query_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = [(k, t) for k, t in enumerate(terms_of(text or "", stems)) if t]
                if phrase:
                    out += [(i, k - found[0][0], t) for k, t in found]
                else:
                    out += [(i, k, t) for k, t in enumerate(dict.fromkeys(t for _, t in found))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["query_id", "slot", "term"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "query_id bigint, slot int, term string")


def cover_density(slots: list[set[int]]) -> float:
    """The rank of a passage in which the terms stand at these positions."""
    merged = sorted((p, s) for s, ps in enumerate(slots) for p in ps)
    last, begun, out = [-1] * len(slots), -1, 0.0
    for k, (p, s) in enumerate(merged):
        last[s] = k
        first = min(last)
        if first > begun:
            begun = first
            out += 0.1 / (1 + (p - merged[first][0]) - (k - first))
    return out


def phrase_density(slots: list[tuple[int, set[int]]]) -> float:
    """The same where each term must stand at its distance from the first."""
    starts = set.intersection(*({p - d for p in ps} for d, ps in slots))
    words = {d for d, _ in slots}
    return len(starts) * 0.1 / (1 + max(words) + 1 - len(words))


_RANKED = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def _ranked(phrase: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                slots: dict[int, set[int]] = {}
                for x in r["found"]:
                    slots.setdefault(x["slot"], set()).update(np.cumsum(unpacked(x["positions"])).tolist())
                score = phrase_density(sorted(slots.items())) if phrase else cover_density([slots[s] for s in sorted(slots)])
                if score:
                    out.append((r["query_id"], r["chunk_id"], round(score, 6)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_RANKED)], schema=_RANKED)

    return run


def search(queries: DataFrame, index: Index, who: Principal | None = None, mode: str = "any", k: int = 40) -> DataFrame:
    """query_id, chunk_id, score and rank of the k best passages of each query (query_id, text). mode: any, all or phrase."""
    if mode not in ("any", "all", "phrase"):
        raise ValueError(f"no such mode: {mode}")
    terms = shared.kept(_asked(queries, index.stems, mode == "phrase").withColumn("bucket", _bucket(index.buckets)), "asked")
    met = index.found(terms, who, mode != "any").join(terms.select("query_id", "slot", "term"), "term")
    if mode == "any":
        return top(met.groupBy("query_id", "chunk_id").agg(F.round(F.sum("tf") * F.lit(0.1), 6).alias("score")), k)
    wanted = terms.groupBy("query_id").agg(F.countDistinct("slot").alias("slots"))
    grouped = met.groupBy("query_id", "chunk_id").agg(F.collect_list(F.struct("slot", "positions")).alias("found"), F.countDistinct("slot").alias("slots"))
    whole = grouped.join(wanted, ["query_id", "slots"]).select("query_id", "chunk_id", "found")
    return top(whole.mapInArrow(_ranked(mode == "phrase"), "query_id bigint, chunk_id bigint, score double"), k)
