"""Counts of many keys over the whole corpus, kept in blocks: no row for a single key is ever shuffled.

Each block of documents asks, for the keys it holds, in one binary for each bucket of the key space (keys sorted,
differences in few bytes); a bucket's task merges what the blocks ask and answers each in the same order; the block's
task reads the answers by position. A key that a third of the corpus holds is one key of each block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MESSAGE = "block bigint, bucket int, round int, blob binary"
MESSAGE_OUT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("round", pa.int32()), ("blob", pa.binary())])
Blob = Callable[..., bytes]


def pack(*parts: object) -> bytes:
    """Arrays and plain values. Sorted 64-bit keys are best given as squeeze(keys)."""
    return pickle.dumps(parts, 5)


def unpack(blob: bytes) -> tuple:
    return pickle.loads(blob)  # noqa: S301  written by pack() in the same job


def squeeze(keys: np.ndarray) -> tuple[int, int, bytes]:
    """Ascending unsigned numbers as differences of as many bytes as the largest needs."""
    d = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return len(d), width, np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def expand(packed: tuple[int, int, bytes]) -> np.ndarray:
    n, width, raw = packed
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    return np.cumsum(d.reshape(-1).view(np.uint64), dtype=np.uint64)


def small(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the narrowest type that holds them."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def short(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mostly small counts: a byte each, and the large ones apart."""
    big = np.flatnonzero(x >= 255)
    return np.minimum(x, 255).astype(np.uint8), small(big), small(x[big])


def long(parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    out = parts[0].astype(np.int64)
    out[parts[1].astype(np.int64)] = parts[2].astype(np.int64)
    return out


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, MESSAGE_OUT, strict=True)], schema=MESSAGE_OUT)


def asked(blocks: DataFrame, ask: Callable[[int, bytes], list[tuple[int, bytes]]], round_: int) -> DataFrame:
    """What the blocks (block, payload) ask: ask(block, payload) gives (bucket, blob) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist(), strict=True):
                for bucket, blob in ask(block, payload):
                    yield messages([(block, bucket, round_, blob)]).to_batches()[0]

    return blocks.select("block", "payload").mapInArrow(run, MESSAGE)


def answered(asks: DataFrame, merge: Callable[[list[bytes]], tuple[list[bytes], bytes | None]]) -> DataFrame:
    """merge(blobs of a bucket) gives an answer for each, in order, and what the bucket tells of itself, if anything:
    a row of block -1."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out, own = merge([r["blob"] for r in rows])
        told = [] if own is None else [(-1, rows[0]["bucket"], rows[0]["round"], own)]
        return messages([(r["block"], r["bucket"], r["round"], x) for r, x in zip(rows, out, strict=True)] + told)

    return asks.groupBy("bucket").applyInArrow(run, MESSAGE)


def concluded(blocks: DataFrame, answers: DataFrame, finish: Callable[[int, bytes, dict], pa.Table], schema: str) -> DataFrame:
    """finish(block, payload, {(round, bucket): answer}) makes the block's rows. A third column of blocks, where there is
    one, is what the block has kept for itself: the answer (-1, -1)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {(r["round"], r["bucket"]): r["blob"] for r in right.to_pylist()}
        rows = left.to_pylist()
        if not rows:
            return finish(-1, b"", {})
        got[-1, -1] = rows[0].get("own")
        return finish(rows[0]["block"], rows[0]["payload"], got)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def alone(blocks: DataFrame, finish: Callable[[int, bytes, dict], pa.Table], schema: str) -> DataFrame:
    """As concluded(), where a block needs no answer but what it has kept: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from finish(r["block"], r["payload"], {(-1, -1): r["own"]}).to_batches()

    return blocks.mapInArrow(run, schema)
