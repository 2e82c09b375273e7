"""Packing of documents into token windows by minimum bin slack [operator 3].

Documents longer than a window give whole windows; what remains of each is packed. For a window the longest remaining
length is set, and a bitset subset-sum dynamic program over the multiset of the other remaining lengths finds the
filling closest to capacity; the counts used of each length are traced back through the stored bitsets. A filling
serves again while its lengths last. Slack that no multiset fills is filled by cutting a piece off the next document.
What is left at the end, less than a window, is cut into powers of two, which need no padding.

Each task packs its own documents in blocks of a bounded number of tokens, so nothing is shuffled, and a task that runs
again, on the same split, gives the same windows. sequence_id is unique over the whole table.

Cases: a null or empty text is the end id alone; ids may be null or repeated (each row is packed); an empty table gives
no rows; other columns are ignored; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cairn.llm import word_bpe
from cairn.llm.common import batch, text_of

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: Tokens held by a task at once.
BLOCK = 3_000_000


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the lengths in counts whose sum is at most capacity and closest to it: length -> how many.

    reach is a bitset: bit s is set if some multiset of the lengths so far sums to s. A length's count is split in
    powers of two, so its whole multiplicity costs few shifts. The program ends early at an exact filling.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (k * length)) & full
            left, k = left - k, 2 * k
            if reach >> capacity & 1:
                break
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):  # if the sum was reached without this step, it isn't used
        if not before >> at & 1:
            at -= k * length
            used[length] = used.get(length, 0) + k
    return used


def plan(lengths: list[int], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document's index, start, length); each document is laid out once and whole."""
    begun = [0] * len(lengths)
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        while n - begun[i] >= capacity:
            yield [(i, begun[i], capacity)]
            begun[i] += capacity
        if n > begun[i]:
            stacks.setdefault(n - begun[i], []).append(i)

    def take(length: int, most: int | None = None) -> tuple[int, int, int]:
        i = stacks[length].pop()
        if not stacks[length]:
            del stacks[length]
        n = length if most is None else most
        piece = (i, begun[i], n)
        begun[i] += n
        if n < length:
            stacks.setdefault(length - n, []).append(i)
        return piece

    total = sum(n * len(s) for n, s in stacks.items())
    while total >= capacity:
        counts = {n: len(s) for n, s in stacks.items()}
        first = max(counts)
        counts[first] -= 1
        used = fill({n: c for n, c in counts.items() if c}, capacity - first)
        used[first] = used.get(first, 0) + 1
        slack = capacity - sum(n * c for n, c in used.items())
        again = 1 if slack else max(1, min(len(stacks[n]) // c for n, c in used.items()))
        for _ in range(again):
            window = [take(n) for n, c in sorted(used.items(), reverse=True) for _ in range(c)]
            while slack:
                n = max(stacks)
                cut = min(n, slack)
                window.append(take(n, cut))
                slack -= cut
            total -= capacity
            yield window
    rest = [take(n) for n in sorted(stacks, reverse=True) for _ in range(len(stacks[n]))]
    while total:
        size, window = 1 << (total.bit_length() - 1), []
        total -= size
        while size:
            i, start, n = rest.pop()
            if n > size:
                rest.append((i, start + size, n - size))
                n = size
            window.append((i, start, n))
            size -= n
        yield window


def pack(docs: DataFrame, file: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: the document's ids from start on, length of them, and where they lie."""
    file = file or word_bpe.path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe.encoder(file).ids
        sequence = TaskContext.get().partitionId() << 38

        def block(ids: list, raw: list[bytes]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            lengths = [len(r) // 4 for r in raw]
            for window in plan(lengths, capacity):
                offset = 0
                for i, start, n in window:
                    rows.append((ids[i], start, n, zlib.crc32(raw[i][4 * start : 4 * (start + n)]), lengths[i], sequence, offset))
                    offset += n
                sequence += 1
            return batch(_OUT, list(zip(*rows, strict=True)) or [[]] * 7)

        ids, raw, held = [], [], 0
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = encode(text) + end
                ids.append(i)
                raw.append(got)
                held += len(got) // 4
                if held >= BLOCK:
                    yield block(ids, raw)
                    ids, raw, held = [], [], 0
        if ids:
            yield block(ids, raw)

    return text_of(docs).mapInArrow(run, SCHEMA)
