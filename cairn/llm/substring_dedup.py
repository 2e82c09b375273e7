"""Exact removal of repeated byte strings by suffix arrays [operator 5].

A byte goes if it is covered by a string of a given length (LENGTH bytes) that also starts elsewhere. To know that of every start in the
corpus without one suffix array over all of it:

1. Each text is cut into segments. The least hash among a string's GRAM-byte grams depends on that string alone, so equal
   strings have equal least hashes; a segment is a run of starts with one least hash, with the bytes their strings cover.
2. Segments are counted by their least hash and by their content, both summed in the tasks first. A segment whose content
   occurs twice repeats as a whole; one whose hash no other content has, and no gram of its own repeats, holds no repeat.
3. The rest, one of each content, are sent to shards by their least hash, and shards build suffix arrays by induced
   sorting, and permuted common prefixes, in pieces of bounded size: a start repeats if a neighbour in order has LENGTH
   bytes in common with it.
4. Where one hash has more than HOT contents (a passage that very many documents share), its segments are not put into
   one shard: the strings at their starts are counted by 128-bit hashes in an exchange between blocks and buckets.

The ranges of repeated starts return to their documents by id and text hash. Equality in steps 2 and 4 is that of 128-bit
hashes, in step 3 that of the bytes.

digest() also tells of repeats of PASSAGE bytes, which are shorter. It finds those first: all the PASSAGE-byte strings
within a repeated string of LENGTH bytes repeat too, so longer repeats can only lie in runs of such starts, and the
second search reads nothing but these runs.

Cases: a null text counts as empty; texts of fewer than LENGTH bytes keep all; equal rows are documents of their own,
each a copy of the other; ids may be null; an empty table gives no rows; other columns are ignored (kept by
remove_repeats()).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import exchange
from cairn.llm.common import batch, frugal, materialise, mix64, partitions, release, unused
from cairn.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, GRAM, LONGEST = 400, 32, 1024
#: Bytes of a passage of about fifty words: 95 to 97 of 100 runs of fifty words in the test tables have more.
PASSAGE = 256
HOT, PIECE, HOT_BLOCK = 2048, 2_000_000, 2_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SEGMENTS = "doc_id bigint, th bigint, lo int, n int, fp bigint, a bigint, b bigint, again boolean"
_SEGMENTS_OUT = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("fp", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("again", pa.bool_())]
)


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number."""
    n = len(raw) - 7
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (n, 8), (1, 1))).view(np.uint64).ravel()


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    w = words_at(raw)
    g = len(raw) - GRAM + 1
    h = w[:g] * _ODD[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h = (h + w[8 * k : 8 * k + g]) * _ODD[k]
    return mix64(h)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of width values: prefix and suffix minima of blocks."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """First start, number of starts, least hash and whether it occurs more than once, of each segment."""
    raw = np.frombuffer(text, np.uint8)
    h = gram_hashes(raw)
    width = length - GRAM + 1
    least = sliding_least(h, width)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    lo = np.concatenate(([0], change))
    n = np.diff(np.append(lo, len(least)))
    if n.max() > LONGEST:  # a periodic text keeps one least hash: cut it into segments of bounded length
        parts = -(-n // LONGEST)
        shift = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(lo + n, parts)
        lo = np.repeat(lo, parts) + shift * LONGEST
        n = np.minimum(end - lo, LONGEST)
    fp = least[lo]
    again = [np.count_nonzero(h[a : a + k + width - 1] == v) > 1 for a, k, v in zip(lo.tolist(), n.tolist(), fp, strict=True)]
    return lo, n, fp, again


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, ths, los, ns, fps, hashes, agains = [], [], [], [], [], [], []
        for i, th, raw in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("raw").to_pylist(), strict=True):
            if not raw or len(raw) < length:
                continue
            lo, n, fp, again = segments(raw, length)
            ids += [i] * len(lo)
            ths += [th] * len(lo)
            los.append(lo)
            ns.append(n)
            fps.append(fp)
            agains += again
            hashes += [xxhash.xxh3_128_digest(raw[a : a + k + length - 1]) for a, k in zip(lo.tolist(), n.tolist(), strict=True)]
        if ids:
            two = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield batch(_SEGMENTS_OUT, [ids, ths, np.concatenate(los).astype(np.int32), np.concatenate(ns).astype(np.int32), np.concatenate(fps).view(np.int64), two[:, 0], two[:, 1], agains])


_BYTES = "fp bigint, doc_id bigint, th bigint, lo int, n int, twice boolean, hot boolean, bytes binary"
_BYTES_OUT = pa.schema([("fp", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_()), ("hot", pa.bool_()), ("bytes", pa.binary())])
_RANGES = "doc_id bigint, th bigint, lo int, n int"
_RANGES_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])


def _extract(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, held = [], 0
        for r in b.to_pylist():
            raw = r["raw"]
            for x in r["wanted"]:
                rows.append((x["fp"], r["doc_id"], r["th"], x["lo"], x["n"], x["twice"], x["hot"], raw[x["lo"] : x["lo"] + x["n"] + length - 1]))
                held += len(rows[-1][-1])
            if held > 4_000_000:
                yield batch(_BYTES_OUT, list(zip(*rows, strict=True)))
                rows, held = [], 0
        if rows:
            yield batch(_BYTES_OUT, list(zip(*rows, strict=True)))


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def repeated_starts(pieces: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, of its first counts[i] starts, whether length bytes from there on also start elsewhere in the
    pieces. Pieces are joined by a byte that UTF-8 has not, which no such string reaches."""
    s = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)
    sa = suffix_array(s.astype(np.int64))
    near = permuted_prefixes(s, sa)[sa]
    group = np.cumsum(near < length)
    valid = np.zeros(len(s), bool)
    at = np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1].tolist()
    for a, k in zip(at, counts, strict=True):
        valid[a : a + k] = True
    sizes = np.bincount(group[valid[sa]], minlength=int(group[-1]) + 1)
    flag = np.zeros(len(s), bool)
    flag[sa] = sizes[group] > 1
    flag &= valid
    return [flag[a : a + k] for a, k in zip(at, counts, strict=True)]


def _shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fp -> ranges of repeated starts, by pieces of whole fps of about PIECE bytes."""
    held: list[dict] = []
    size = 0

    def solve() -> pa.RecordBatch:
        out = []
        for r, f in zip(held, repeated_starts([r["bytes"] for r in held], [r["n"] for r in held], length), strict=True):
            if not r["twice"]:
                out += [(r["doc_id"], r["th"], r["lo"] + a, k) for a, k in _runs(f)]
        return batch(_RANGES_OUT, list(zip(*out, strict=True)) or [[]] * 4)

    for b in batches:
        for r in b.to_pylist():
            if size > PIECE and r["fp"] != held[-1]["fp"]:
                yield solve()
                held, size = [], 0
            held.append(r)
            size += len(r["bytes"])
    if held:
        yield solve()


def string_hashes(raw: bytes, n: int, length: int = LENGTH) -> np.ndarray:
    """Two 64-bit hashes of the length bytes at each of the first n starts, by differences of running sums."""
    w = words_at(np.frombuffer(raw, np.uint8))
    m = length - 7
    out = np.empty((n, 2), np.uint64)
    i = np.arange(len(w), dtype=np.uint64)
    for k in (0, 1):
        base = int(_ODD[k]) | 1
        powers, back = np.full(len(w) + 1, base, np.uint64), np.full(len(w) + 1, pow(base, -1, 2**64), np.uint64)
        powers[0] = back[0] = 1
        powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        g = mix64(w * _ODD[2 + k] + np.uint64(k + 1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(g * powers[: len(i)], dtype=np.uint64)))
        out[:, k] = (sums[m : m + n] - sums[:n]) * back[:n]
    return mix64(out.ravel()).reshape(n, 2)


def _hot_ranges(hot: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated starts of the hot segments, by an exchange of hashes between blocks and buckets."""
    spark = hot.sparkSession
    buckets = partitions(spark)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
        pid, k, held = TaskContext.get().partitionId(), 0, []
        for b in batches:
            for r in b.to_pylist():
                held.append((r["doc_id"], r["th"], r["lo"], r["n"], r["twice"], string_hashes(r["bytes"], r["n"], length)))
                if len(held) == HOT_BLOCK:
                    yield batch(out, [[pid << 32 | k], [exchange.pack(held)]])
                    held, k = [], k + 1
        if held:
            yield batch(out, [[pid << 32 | k], [exchange.pack(held)]])

    blocks = materialise(hot.repartition(buckets, "doc_id", "th", "lo").mapInArrow(to_blocks, "block bigint, payload binary"), "hot")

    def keys(payload: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, list]:
        (held,) = exchange.unpack(payload)
        h = np.concatenate([x[5] for x in held])
        two = h[:, 0].astype(np.uint64), h[:, 1].astype(np.uint64)
        order = np.lexsort((two[1], two[0]))
        a, b = two[0][order], two[1][order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        which = np.empty(len(a), np.int64)
        which[order] = np.cumsum(new) - 1
        n = np.bincount(which)
        a, b = a[new], b[new]
        ends = np.searchsorted(a, [np.uint64((k << 64) // buckets) for k in range(1, buckets)])
        return held, which, n, np.stack((a, b)), [0, *ends.tolist(), len(a)]

    def ask(_block: int, payload: bytes) -> list[tuple[int, bytes]]:
        _, _, n, ab, cut = keys(payload)
        return [(k, exchange.pack(exchange.squeeze(ab[0][x:y]), ab[1][x:y], exchange.small(n[x:y]))) for k, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]

    def merge(blobs: list[bytes]) -> tuple[list[bytes], None]:
        parts = [exchange.unpack(x) for x in blobs]
        a = np.concatenate([exchange.expand(p[0]) for p in parts])
        b = np.concatenate([p[1] for p in parts])
        n = np.concatenate([p[2].astype(np.int64) for p in parts])
        order = np.lexsort((b, a))
        new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        often = np.bincount(group, n)[group] > 1
        ends = np.cumsum([p[0][0] for p in parts])[:-1]
        return [exchange.pack(np.packbits(x), len(x)) for x in np.split(often, ends)], None

    def finish(_block: int, payload: bytes, answers: dict) -> pa.Table:
        out = []
        if payload:
            held, which, _, _, cut = keys(payload)
            often = np.zeros(cut[-1], bool)
            for k, (x, y) in enumerate(zip(cut, cut[1:])):
                if y > x:
                    bits, m = exchange.unpack(answers[0, k])
                    often[x:y] = np.unpackbits(bits, count=m)
            flags, at = often[which], 0
            for i, th, lo, n, twice, _ in held:
                if not twice:
                    out += [(i, th, lo + a, k) for a, k in _runs(flags[at : at + n])]
                at += n
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 4, _RANGES_OUT, strict=True)], schema=_RANGES_OUT)

    return exchange.concluded(blocks, exchange.answered(exchange.asked(blocks, ask, 0), merge), finish, _RANGES)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs has doc_id, th and raw (bytes), told apart by doc_id and th -> doc_id, th, lo, n: ranges of starts whose
    strings also start elsewhere, written out."""
    spark = docs.sparkSession
    parts = partitions(spark)
    cut = materialise(docs.mapInArrow(lambda it: _cut(it, length), _SEGMENTS), "segments")
    content = cut.groupBy("fp", "a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "lo")).alias("rep"), F.first("n").alias("n"), F.max("again").alias("again"))
    by_hash = content.groupBy("fp").agg(F.count(F.lit(1)).alias("contents"), F.max("again").alias("any"), F.max("c").alias("most"))
    kept = by_hash.where("contents > 1 OR any OR most > 1").select("fp", "contents", "any")
    shared = materialise(content.join(kept, "fp"), "shared")
    whole = cut.join(shared.where("c > 1").select("fp", "a", "b"), ["fp", "a", "b"]).select("doc_id", "th", "lo", "n")
    open_ = shared.where("contents > 1 OR any")
    hot = F.col("contents") > HOT
    n_hot, size = open_.agg(F.count(F.when(hot, 1)), F.sum(F.when(~hot, F.col("n") + length - 1))).first()
    wanted = open_.groupBy(F.col("rep.doc_id").alias("i"), F.col("rep.th").alias("t")).agg(
        F.collect_list(F.struct(F.col("rep.lo").alias("lo"), "n", "fp", (F.col("c") > 1).alias("twice"), hot.alias("hot"))).alias("wanted")
    )
    found = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
    pieces = found.select("doc_id", "th", "raw", "wanted").mapInArrow(lambda it: _extract(it, length), _BYTES)
    held = [cut, shared]
    if n_hot:
        pieces = materialise(pieces, "pieces")
        held.append(pieces)
    shards = max(parts, 1 + (size or 0) // (8 * PIECE))
    ranges = pieces.where("NOT hot").repartition(shards, "fp").sortWithinPartitions("fp").mapInArrow(lambda it: _shard(it, length), _RANGES)
    if n_hot:
        ranges = ranges.unionByName(_hot_ranges(pieces.where("hot"), length))
    out = materialise(whole.unionByName(ranges), "ranges")
    release(*held)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("raw"))


def _with_ranges(docs: DataFrame, ranges: DataFrame, i: str, t: str, name: str) -> DataFrame:
    """docs (told apart by columns i and t) and, as name, the array of their ranges, null where there are none."""
    of, th = unused(docs, "of_id"), unused(docs, "of_text")
    lists = ranges.groupBy(F.col("doc_id").alias(of), F.col("th").alias(th)).agg(F.collect_set(F.struct("lo", "n")).alias(name))
    return docs.join(lists.hint("shuffle_hash"), F.col(i).eqNullSafe(F.col(of)) & (F.col(t) == F.col(th)), "left")


def starts(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of repeated starts, as (first, one past the last)."""
    out: list[list[int]] = []
    for lo, n in sorted((r["lo"], r["n"]) for r in ranges or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], lo + n)
        else:
            out.append([lo, lo + n])
    return [(a, b) for a, b in out]


def spans(ranges: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal removed runs, as (first byte, one past the last)."""
    out: list[tuple[int, int]] = []
    for a, b in starts(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b - 1 + length)
        else:
            out.append((a, b - 1 + length))
    return out


def kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    if not gone:
        return raw
    starts = [0, *(b for _, b in gone)]
    return b"".join(raw[a:b] for a, b in zip(starts, [*(a for a, _ in gone), len(raw)], strict=True))


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_bytes bigint, n_passages bigint"
_RESULT_OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), *((n, pa.int64()) for n in ("n_passage_bytes", "n_passages"))])
_PARTS = "doc_id bigint, th bigint, at int, sub bigint, raw binary"
_PARTS_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("sub", pa.int64()), ("raw", pa.binary())])


def digest(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """Of each document: bytes, removed bytes, removed runs and the digest of what is left, by strings of length bytes;
    and the bytes and maximal runs that repeated strings of passage bytes (fewer than length) cover, which stay."""
    rows = keyed(docs)
    short = repeats(rows, passage)
    marked = materialise(_with_ranges(rows, short, "doc_id", "th", "shorts").select("doc_id", "th", "raw", "shorts"), "marked")
    least = length - passage + 1  # starts of a run that a longer repeat can lie in

    def long_runs(ranges: list[dict] | None) -> list[tuple[int, int]]:
        return [(a, b) for a, b in starts(ranges) if b - a >= least]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, th, raw, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "raw", "shorts")), strict=True):
                runs = long_runs(ranges)
                if runs:
                    subs = [xxhash.xxh3_64_intdigest(f"{th} {x}") - 2**63 for x, _ in runs]
                    yield batch(_PARTS_OUT, [[i] * len(runs), [th] * len(runs), [x for x, _ in runs], subs, [raw[x : y - 1 + passage] for x, y in runs]])

    parts = materialise(marked.where("shorts IS NOT NULL").mapInArrow(cut, _PARTS), "parts")
    found = repeats(parts.select("doc_id", F.col("sub").alias("th"), "raw"), length)
    whence = parts.select(F.col("doc_id").alias("i"), F.col("th").alias("whole"), F.col("sub").alias("s"), "at").distinct()
    ranges = found.join(whence, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("s"))).select("doc_id", F.col("whole").alias("th"), (F.col("at") + F.col("lo")).alias("lo"), "n")
    long = materialise(ranges, "long")
    release(short, parts, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, raw, shorts, longs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "raw", "shorts", "longs")), strict=True):
                raw = raw or b""
                gone, passages = spans(longs, length), spans(shorts, passage)
                out.append((i, len(raw), sum(y - x for x, y in gone), len(gone), hashlib.sha256(kept_bytes(raw, gone)).hexdigest(), sum(y - x for x, y in passages), len(passages)))
            yield batch(_RESULT_OUT, list(zip(*out, strict=True)) or [[]] * 7)

    # texts without a passage are not shuffled again
    without = marked.where("shorts IS NULL").select("doc_id", "raw", "shorts", F.col("shorts").alias("longs"))
    joined = _with_ranges(marked.where("shorts IS NOT NULL"), long, "doc_id", "th", "longs").select("doc_id", "raw", "shorts", "longs")
    return without.union(joined).mapInArrow(run, _RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, all rows and columns, with repeated strings removed from text (characters of which only a part is left go
    too), and n_chars, where there is one, of what is left. A null text stays null."""
    text = F.col("text").cast("string")
    i, t, ranges = (unused(docs, n) for n in ("id_", "text_hash", "ranges"))
    marked = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.xxhash64(text)})
    joined = _with_ranges(marked, repeats(keyed(docs), length), i, t, ranges)

    @F.pandas_udf("string")
    def clean(text, ranges):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if t is None else t if r is None else kept_bytes(t.encode("utf-8", "surrogatepass"), spans(list(r), length)).decode("utf-8", "ignore") for t, r in zip(text, ranges, strict=True)], dtype=object)

    out = joined.select(*[F.col(c) if c != "text" else clean("text", ranges).alias("text") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
