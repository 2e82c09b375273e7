"""Token counts by a map-side two-tier lookup [operator 4].

One pass over all texts keeps, in each task, the most frequent white-space chunks (bounded summaries; no chunk
occurrence is shuffled), whose lengths in tokens form a compact table that is broadcast. The second pass looks chunks up
in it, then in the worker's cache, and encodes what both lack. Nothing but the bounded summaries is shuffled.

Cases: a null text counts as empty (0 bytes, 0 tokens); ids may be null or repeated, every row has its own result; an
empty table gives no rows; other columns are ignored; texts are read whole, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import word_bpe
from cairn.llm.common import batch, text_of

#: Entries of the broadcast table, and of each task's summary: the bounds of what is sent.
TABLE, SUMMARY, HELD = 32_768, 4_096, 200_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_SUMMARY = pa.schema([("chunk", pa.string()), ("n", pa.int64())])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            if text:
                seen.update(text.lower().split())
        if len(seen) > HELD:  # lossy counting: the rare are forgotten
            floor = sorted(seen.values(), reverse=True)[HELD // 4]
            seen = Counter({k: n for k, n in seen.items() if n > floor})
    top = seen.most_common(SUMMARY)
    yield batch(_SUMMARY, [[k for k, _ in top], [n for _, n in top]])


def frequent_chunks(docs: DataFrame) -> list[str]:
    """The corpus's most frequent chunks; TABLE at most reach the driver."""
    found = text_of(docs).select("text").mapInArrow(_summaries, "chunk string, n bigint")
    top = found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(TABLE)
    return [r["chunk"] for r in top.collect()]


def count_tokens(docs: DataFrame, file: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document, by the vocabulary in file."""
    file = file or word_bpe.path()
    made = word_bpe.WordBpe(file, lengths=True)
    table = {c: made.chunks[c] for c in frequent_chunks(docs) if made.plain(c)}
    shared = docs.sparkSession.sparkContext.broadcast((str(hash(frozenset(table.items()))), table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_id, frequent = shared.value
        count = word_bpe.encoder(file, True, table_id, frequent).count
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [count(t) for t in texts]
            yield batch(_OUT, [b.column("doc_id"), [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], n, [k > limit for k in n]])

    return text_of(docs).mapInArrow(run, SCHEMA)
