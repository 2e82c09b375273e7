"""Vector code compression by Yinyang Lloyd [operator 13].

Vectors of whole numbers are cut into parts; each part position has a codebook, refined by rounds of Lloyd's assignment and
averaging. The entries of a codebook are clustered into groups once. A row keeps, for each of its parts, the entry it has
and a lower bound of its distance to each group's other entries. After entries have moved, a bound is lowered by its group's
largest drift; groups whose bound still exceeds the distance to the present entry are not looked at. Bounds are kept in half
precision, rounded down, and drifts are rounded up; a group is passed by only if its bound is larger, never if equal, and
what decides, ties included, are squared distances in whole numbers.

State is a column of the row: each round reads the table of the last and writes one, without a shuffle; what is sent are a
task's sums and counts for each entry. The codebooks are of a fixed size and go through the driver.

Whole numbers of any size are summed exactly, in digits of 32 bits; rows with components beyond what doubles square exactly
are compared in Python's integers, with bounds of zero.

Cases: rows with a null vector, a null or non-finite component take no part, nor do those whose length is not that of the
row with the smallest id or which cannot be cut; a null id comes last and is kept; of equal ids the smaller vector is first;
fewer rows than entries give fewer entries; repeated rows and ties are as stated; sums beyond a long are the largest long; an
empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batch, materialise, release

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries in a group, on average.
GROUP = 10
_MOST, _LONG = float(np.finfo(np.float16).max), (1 << 63) - 1
#: Labels with more than one in COMMON of the rows are joined apart: there are fewer than COMMON.
COMMON = 1024
_DIGIT = 32


def whole(values: np.ndarray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) as doubles if all squares of differences over width components are exact there, else as integers."""
    with np.errstate(over="ignore"):
        x = np.floor(values.astype(np.float64) * scale)
    limit = 2.0 ** ((52 - max(1, width).bit_length()) // 2 - 1)
    if not x.size or np.abs(x).max() <= limit:
        return x
    return np.array([math.floor(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in values.astype(np.float64).reshape(-1)], object).reshape(values.shape)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry."""
    if x.dtype == object or entries.dtype == object:
        x, entries = _integers(x), _integers(entries)
        return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64).astype(object)


def down(x: np.ndarray) -> np.ndarray:
    """As half precision, never larger than x and never below zero."""
    x = np.clip(x, 0, _MOST)
    out = x.astype(np.float16)
    over = out > x
    out[over] = np.nextafter(out[over], np.float16(0))
    return out


def groups(entries: np.ndarray, n: int) -> np.ndarray:
    """The group of each entry: a few rounds of clustering around entries that are far apart."""
    if len(entries) <= n:
        return np.arange(len(entries))
    x = np.array([[float(max(-(10**150), min(10**150, int(v)))) for v in e] for e in entries])
    far, at = np.full(len(x), np.inf), [0]
    for _ in range(n - 1):
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
        at.append(int(far.argmax()))
    centres = x[at]
    for _ in range(5):
        of = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(n)])
    return of


class Codebook:
    """A part's entries, their groups, and how far each group has moved at most."""

    def __init__(self, entries: np.ndarray, of: np.ndarray, drift: np.ndarray | None = None):
        self.entries, self.of = entries, of
        self.n = int(of.max()) + 1 if len(of) else 0
        self.members = [np.flatnonzero(of == g) for g in range(self.n)]
        self.drift = np.zeros(self.n) if drift is None else drift

    def moved(self, entries: np.ndarray) -> Codebook:
        each = [math.isqrt(sum(int(a - b) ** 2 for a, b in zip(u, v, strict=True))) + 1 if tuple(u) != tuple(v) else 0 for u, v in zip(_integers(self.entries), _integers(entries), strict=True)]
        return Codebook(entries, self.of, np.array([float(min(10**30, max((each[k] for k in m), default=0))) for m in self.members]))

    def begin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each row, the squared distance, and the bounds, from all distances."""
        d = squared(x, self.entries)
        code = d.argmin(axis=1)
        best = d[np.arange(len(x)), code]
        return code, best, self._bounds(d, code)

    def _bounds(self, d: np.ndarray, code: np.ndarray) -> np.ndarray:
        if d.dtype == object:
            return np.zeros((len(d), self.n), np.float16)
        d = d.copy()
        d[np.arange(len(d)), code] = np.inf
        return down(np.sqrt(np.stack([d[:, m].min(axis=1) for m in self.members], 1) if self.n else np.zeros((len(d), 0))) * (1 - 1e-12))

    def go_on(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """As begin(), after the entries have moved by drift, from the entries and bounds of before; also how many distances
        were computed."""
        if x.dtype == object or self.entries.dtype == object:
            return *self.begin(x), len(x) * len(self.entries)
        own = ((x - self.entries[code]) ** 2).sum(axis=1)
        bounds = bounds.astype(np.float64) - self.drift[None, :]
        old, was, best, code, looked = code, own.copy(), own, code.copy(), len(x)
        upper = np.sqrt(own) * (1 + 1e-12)
        open_ = bounds <= upper[:, None]
        second: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g, members in enumerate(self.members):
            at = np.flatnonzero(open_[:, g])
            if not len(at):
                continue
            looked += len(at) * len(members)
            d = squared(x[at], self.entries[members])
            k = d.argmin(axis=1)
            near, entry = d[np.arange(len(at)), k], members[k]
            better = (near < best[at]) | ((near == best[at]) & (entry < code[at]))
            best[at[better]], code[at[better]] = near[better], entry[better]
            second.append((g, at, d))
        for g, at, d in second:
            # the least but the row's own entry
            mine = self.of[code[at]] == g
            place = np.searchsorted(self.members[g], code[at][mine])
            d[np.flatnonzero(mine), place] = np.inf
            bounds[at, g] = np.sqrt(d.min(axis=1)) * (1 - 1e-12)
        left = np.flatnonzero(code != old)
        g = self.of[old[left]]
        bounds[left, g] = np.minimum(bounds[left, g], np.sqrt(was[left]) * (1 - 1e-12))
        return code, best, down(bounds), looked


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal lists without nulls, as they are."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


_STATE = pa.schema([("codes", pa.binary()), ("bounds", pa.binary())])


def _step(table: DataFrame, books: list[Codebook], scale: int, last: bool) -> DataFrame:
    """table with codes and bounds of these codebooks; the last step gives the error and no bounds."""
    shared = table.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in table.columns if c not in ("codes", "bounds")]
    kept = [c for c in kept if c != "vector"] if last else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        size = len(books[0].entries[0])
        for b in batches:
            n, first = b.num_rows, "codes" not in b.schema.names
            if not n:
                continue
            x = whole(vectors(b.column("vector")), scale, size)
            codes = np.zeros((n, len(books)), np.uint8)
            errors = np.zeros(n, object if x.dtype == object or any(k.entries.dtype == object for k in books) else np.int64)
            held = np.cumsum([0] + [k.n for k in books])
            bounds = np.zeros((n, held[-1]), np.float16)
            if not first:
                was = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(n, -1)
                low = np.frombuffer(b"".join(b.column("bounds").to_pylist()), np.float16).reshape(n, -1)
            for p, book in enumerate(books):
                part, at = x[:, p * size : (p + 1) * size], slice(held[p], held[p + 1])
                codes[:, p], error, bounds[:, at] = book.begin(part) if first else book.go_on(part, was[:, p].astype(np.int64), low[:, at])[:3]
                errors += error if error.dtype == object else error.astype(np.int64)
            out = [b.column(c) for c in kept] + [pa.array([r.tobytes() for r in codes], pa.binary())]
            names = [*kept, "codes"]
            if last:
                out, names = [*out, pa.array([min(int(e), _LONG) for e in errors], pa.int64())], [*names, "error"]
            else:
                out, names = [*out, pa.array([r.tobytes() for r in bounds], pa.binary())], [*names, "bounds"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kinds = dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", codes binary, " + ("error bigint" if last else "bounds binary")
    return table.mapInArrow(run, schema)


_SUMS = pa.schema([("key", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """value by digits of _DIGIT bits, each with the sign of the whole."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield k, sign * (value & ((1 << _DIGIT) - 1))
        value, k = value >> _DIGIT, k + 1


def _averaged(table: DataFrame, books: list[Codebook], scale: int) -> list[Codebook]:
    """The codebooks with each entry moved to the floor of the mean of its parts in table; unused ones stay."""
    parts, entries, size = len(books), len(books[0].entries), len(books[0].entries[0])
    each = size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, each), object)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = whole(vectors(b.column("vector")), scale, size)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
            for p in range(parts):
                own = np.zeros((entries, each), object if x.dtype == object else np.int64)
                if x.dtype == object:
                    np.add.at(own, (codes[:, p], slice(1, None)), x[:, p * size : (p + 1) * size])
                else:
                    for k in range(size):
                        # whole numbers below 2^53 in all: exact
                        own[:, k + 1] = np.bincount(codes[:, p], x[:, p * size + k], entries)
                own[:, 0] = np.bincount(codes[:, p], minlength=entries)
                sums[p] += own
        rows = [(key, digit, n) for key, v in enumerate(sums.reshape(-1)) for digit, n in _digits(int(v))]
        yield batch(_SUMS, list(zip(*rows, strict=True)) or [[]] * 3)

    got = np.zeros(parts * entries * each, object)
    for r in table.select("vector", "codes").mapInArrow(run, "key bigint, digit int, n bigint").groupBy("key", "digit").agg(F.sum("n").alias("n")).collect():
        got[r["key"]] += r["n"] << (_DIGIT * r["digit"])
    out = []
    for book, own in zip(books, got.reshape(parts, entries, each), strict=True):
        new = _integers(book.entries).copy()
        for k in np.flatnonzero(own[:, 0] > 0):
            new[k] = [v // own[k, 0] for v in own[k, 1:]]
        out.append(book.moved(_narrowest(new, size)))
    return out


def _narrowest(entries: np.ndarray, width: int) -> np.ndarray:
    """Entries as doubles where these are exact."""
    limit = 2 ** ((52 - max(1, width).bit_length()) // 2 - 1)
    return entries.astype(np.float64) if not entries.size or max(abs(int(v)) for v in entries.reshape(-1)) <= limit else entries


def _usable(col: Column, parts: int, length: int) -> Column:
    inf = F.lit(float("inf"))
    return col.isNotNull() & (F.size(col) == length) & (length % parts == 0) & (length > 0) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def _with_label_error(rows: DataFrame) -> DataFrame:
    """rows with the error summed over rows of an equal label. Labels of many rows are few and broadcast; no other has
    enough rows to weigh on one task."""
    key = [F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name")]
    most = F.lit(_LONG).cast("decimal(38,0)")
    sums = materialise(rows.groupBy(*key).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n")), "label-errors")
    n = sums.agg(F.sum("n")).first()[0] or 0
    sums = sums.select("none", "name", F.least("total", most).cast("long").alias("label_error"), (F.col("n") * COMMON > n).alias("common"))
    keyed = rows.select("*", *key)
    first = keyed.join(F.broadcast(sums.where("common").drop("common")), ["none", "name"], "left")
    rest = first.where("label_error IS NULL").drop("label_error").join(sums.where("NOT common").drop("common"), ["none", "name"])
    return first.where("label_error IS NOT NULL").union(rest.select(*first.columns)).drop("none", "name")


def compress(table: DataFrame, id_col: str = "vec_id", col: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (hexadecimal, two digits a part), error, label_error and codebooks_sha256 of every usable vector; at most
    256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    own = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(col).alias("vector"))
    first = own.where(_usable(F.col("vector"), parts, F.size("vector"))).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return own.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    length = len(first[0]["vector"])
    size = length // parts
    own = own.where(_usable(F.col("vector"), parts, F.lit(length)))
    start = own.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    seeds = whole(np.array([r["vector"] for r in start], np.float64), scale, size)
    books = []
    for p in range(parts):
        part = seeds[:, p * size : (p + 1) * size]
        books.append(Codebook(part, groups(part, max(1, -(-len(part) // GROUP)))))
    state = own
    for r in range(rounds):
        next_ = materialise(_step(state, books, scale, last=False), f"codes-{r}")
        if r:
            release(state)
        state, books = next_, _averaged(next_, books, scale)
    rows = materialise(_step(state, books, scale, last=True), "coded")
    if rounds:
        release(state)
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for e in b.entries for v in e).encode()).hexdigest()
    return _with_label_error(rows).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
