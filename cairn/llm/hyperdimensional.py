"""Language identification by hyperdimensional profiles [operator 11].

Every letter has a random vector of DIMENSIONS signs, drawn from its code point by a hash, so that all workers have the
same. A trigram of letters is bound from the three, the first turned by two places, the second by one: the product, which
no other order of the letters gives. A text's profile is the sum (bundle) of its trigrams' vectors, a language's prototype
that of all its training documents; a text is of the language with the largest cosine.

Letters are Unicode's, in lower case, with the marks that combine with them; all between two runs of letters is one blank,
and so are a text's ends. Nothing but the text is read for a prediction.

Training merges the trigram counts of a task's documents before they are bundled, and a task sends one sum for each
language and dimension. Prototypes reach the workers BLOCK languages at a time, so that a broadcast is of BLOCK vectors at
most; more languages take more blocks, each of which keeps the best so far.

Cases: a null text, an empty one and one without a letter is `und` with score 0, and so is every text if nothing was
learned; documents with a null language or no letter are not learned from; an empty language is a language; equal cosines
(to twelve places) go to the smaller language; a null id is in the fold of the empty string; repeated rows are documents of
their own; an empty table gives no rows; other columns pass by; texts are read whole, PIECE characters at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batch, frugal, materialise, mix64, release

DIMENSIONS = 1024
#: Training takes the documents whose crc32(doc_id as text) mod FOLDS is not HELD.
FOLDS, HELD = 4, 2
#: Languages in a broadcast; characters of a text at a time; trigrams bound at a time; trigrams of a task's languages before they are bundled.
BLOCK, PIECE, BOUND, PENDING = 4096, 1 << 20, 2048, 1 << 19
UNKNOWN = "und"
#: Letter vectors a worker holds.
_HELD_LETTERS = 20_000
_BITS, _LOW = np.uint64(21), np.uint64((1 << 21) - 1)


def _fold(point: int) -> int:
    """The letter's lower case, or 0 for what is no part of a word."""
    x = chr(point)
    if not x.isalpha() and unicodedata.category(x)[0] != "M":
        return 0
    low = x.lower()
    return ord(low) if len(low) == 1 else point


_TABLE = np.array([_fold(c) for c in range(0x10000)], np.uint32)


def folded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        each, of = np.unique(points[far], return_inverse=True)
        out[far] = np.array([_fold(int(c)) for c in each], np.uint32)[of]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct trigrams, three code points of 21 bits in a number, and their counts, for each piece of the text."""
    tail, last = np.zeros(1, np.uint64), 0
    for start in range(0, len(text), PIECE):
        codes = folded(text[start : start + PIECE])
        before = np.concatenate((np.array([last], np.uint32), codes[:-1]))
        last = int(codes[-1])
        run = np.concatenate((tail, codes[(codes != 0) | (before != 0)].astype(np.uint64)))
        if last and start + PIECE >= len(text):
            run = np.concatenate((run, np.zeros(1, np.uint64)))
        tail = run[-2:]
        if len(run) > 2:
            yield np.unique((run[:-2] << _BITS | run[1:-1]) << _BITS | run[2:], return_counts=True)


class Letters(dict):
    """code point -> its vector of signs."""

    def __missing__(self, point: int) -> np.ndarray:
        if len(self) >= _HELD_LETTERS:
            self.clear()
        with np.errstate(over="ignore"):
            words = mix64(np.uint64(point + 1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(DIMENSIONS // 64, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        out = self[point] = np.unpackbits(words.astype("<u8").view(np.uint8)).astype(np.float32) * 2 - 1
        return out

    def of(self, points: np.ndarray, turned: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct points' vectors, turned by so many places, and which each point has."""
        each, at = np.unique(points, return_inverse=True)
        return np.roll(np.array([self[int(p)] for p in each]), turned, axis=1), at


_letters = Letters()


def bundle(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the vectors of distinct, sorted trigrams, as often as they occur: first over the third letters of each
    pair of letters (a matrix product), then over the second, then the first."""
    out = np.zeros(DIMENSIONS)
    for s in range(0, len(keys), BOUND):
        k, n = keys[s : s + BOUND], counts[s : s + BOUND]
        pairs = k >> _BITS
        new = np.concatenate(([True], pairs[1:] != pairs[:-1]))
        row, pairs = np.cumsum(new) - 1, pairs[new]
        third, at = _letters.of(k & _LOW, 0)
        # whole numbers: exact in any order below 2^24, else in doubles
        kind = np.float32 if n.sum() < 1 << 24 else np.float64
        table = np.zeros((len(pairs), len(third)), kind)
        table[row, at] = n
        sums = table @ third.astype(kind, copy=False)
        second, at = _letters.of(pairs & _LOW, 1)
        sums *= second[at]
        firsts = pairs >> _BITS
        heads = np.flatnonzero(np.concatenate(([True], firsts[1:] != firsts[:-1])))
        first, at = _letters.of(firsts[heads], 2)
        for one, lo, hi in zip(at, heads, [*heads[1:], len(firsts)], strict=True):
            out += first[one] * sums[lo:hi].sum(axis=0)
    return out


def profile(text: str) -> np.ndarray:
    out = np.zeros(DIMENSIONS)
    for keys, counts in trigrams(text):
        out += bundle(keys, counts)
    return out


class _Sums:
    """A language's bundle in a task: trigram counts wait until there are enough to merge."""

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0
        self.sum = np.zeros(DIMENSIONS)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n += len(keys)

    def settle(self) -> None:
        if self.waiting:
            keys, at = np.unique(np.concatenate([k for k, _ in self.waiting]), return_inverse=True)
            self.sum += bundle(keys, np.bincount(at, np.concatenate([c for _, c in self.waiting])).astype(np.int64))
            self.waiting, self.n = [], 0


_SUM = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("n", pa.int64())])


def prototypes(docs: DataFrame) -> DataFrame:
    """lang and profile (DIMENSIONS sums) over all rows of docs (columns text, lang) that have a language and a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, _Sums] = {}
        waiting = 0

        def sent() -> pa.RecordBatch:
            for s in sums.values():
                s.settle()
            return batch(_SUM, [np.repeat(list(sums), DIMENSIONS).tolist(), np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(sums)), np.concatenate([s.sum for s in sums.values()]).astype(np.int64)])

        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if lang is None or not has_letter(text):
                    continue
                mine = sums.setdefault(lang, _Sums())
                for keys, counts in trigrams(text):
                    mine.add(keys, counts)
                    waiting += len(keys)
                    if waiting > PENDING:
                        for s in sums.values():
                            s.settle()
                        waiting = 0
                if len(sums) > BLOCK:
                    yield sent()
                    sums, waiting = {}, 0
        if sums:
            yield sent()

    parts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, k int, n bigint")
    whole = parts.groupBy("lang", "k").agg(F.sum("n").alias("n"))
    return whole.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).getField("n").alias("profile"))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()), ("lang_pred", pa.string()), ("score", pa.float64())])
_SCHEMA = "doc_id bigint, held_out boolean, text string, lang_pred string, score double"


def _better(table: DataFrame, langs: list[str], profiles: list[list[int]]) -> DataFrame:
    """table with the best of these languages where it has a larger cosine than that so far (null: none)."""
    shared = table.sparkSession.sparkContext.broadcast((langs, np.array(profiles, np.float64).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = shared.value
        known = known.astype(np.float64)
        known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-300)
        for b in batches:
            best, scores = b.column("lang_pred").to_pylist(), b.column("score").to_pylist()
            for k, text in enumerate(b.column("text").to_pylist()):
                if not has_letter(text):
                    continue
                own = profile(text)
                cosines = np.round(known @ own / max(float(np.linalg.norm(own)), 1e-300), 12)
                top = int(cosines.argmax())
                if best[k] is None or cosines[top] > scores[k]:
                    best[k], scores[k] = names[top], float(cosines[top])
            yield batch(_OUT, [b.column("doc_id"), b.column("held_out"), b.column("text"), best, scores])

    return table.mapInArrow(run, _SCHEMA)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD


def identify(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document (columns doc_id, text, lang), learned from those that are
    not held out."""
    learned = materialise(prototypes(frugal(docs).where(~held_out(F.col("doc_id")))), "prototypes")
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
        F.lit(None).cast("string").alias("lang_pred"),
        F.lit(None).cast("double").alias("score"),
    )
    left = learned
    while rows := left.orderBy("lang").limit(block).collect():
        out = _better(out, [r["lang"] for r in rows], [r["profile"] for r in rows])
        left = learned.where(F.col("lang") > rows[-1]["lang"])
    release(learned)
    return out.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))
