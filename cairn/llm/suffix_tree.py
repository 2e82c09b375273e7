"""Probabilistic suffix tree language model over words [operator 1].

The symbols are lower-cased words and one end for each document; contexts are the last words, as many as it takes. A
context s that occurs twice or more in training is a state of the tree if it passes a divergence test against the next
shorter one, s': over its repeated continuations w the sum of n(s, w) ln(n(s, w) / (n(s) P(w | s'))) is GAIN nats or more,
and for one of them n(s, w) / n(s) is RATIO times P(w | s') or more. (The test takes ln P(w | s') in steps of 1/2048 nat.)
A state's distribution is smoothed by the shorter context's,
with as much weight as it has different continuations, T(s):

    P(w | s) = (n(s, w) + T(s) P(w | s')) / (n(s) + T(s))

Any other context has the distribution of s'; the root is the add-one unigram distribution. Each is a distribution over
the training words and the unknown word. A token is scored in the longest state that is a suffix of its history.

Contexts grow by a word a round, to the left of states alone, so the tree is closed under suffixes; the rounds end when
there is nothing to look at. A state is not gone on from when no context that ends in it can pass the test: their gains
are at most the sum over its repeated continuations of n(s, w) (-ln P(w | s)), and none of these can grow RATIO times
likelier if P(w | s) > 1 / RATIO for all. Nothing is lost by that.

The corpus is read once into blocks of encoded texts and their words' hashes, in a table bucketed by block. Each round
counts by an exchange what the blocks hold, one binary for each block and bucket: no token or n-gram is a shuffled row, and
contexts known to occur less than twice are never asked for. After a few rounds little is live; they then read only the
stretches before live positions, cut from the blocks once for several rounds. A context that holds a large share of all tokens is split over buckets by its
continuations. The model stays in the cluster and grows with the corpus; only the numbers of tokens and of distinct words
come to the driver, summed from one row for each bucket.

Words are told apart by 80-bit hashes; contexts by 20 bits more than it takes to number the tokens (64 at most), so one in
a million shares its counts with another; continuations of one context by 32 bits, so of T different ones a share of
T / 2^32 is counted with another. All blocks see the same, so the sums stay whole.

Cases: a null or empty text is the end alone; a null id counts as the empty text in the held-out rule; ids may be
repeated (each row is scored, and counted if it is for training); with no training row N and V are 0 and every token
scores 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cairn.llm import exchange
from cairn.llm.common import batch, bucketed, materialise, mix64, partitions, ranked, release, sorting, text_of

BLOCK = 1_000_000
#: Bytes of text split into words at once.
SLICE = 4_000_000
GAIN, RATIO = 8.0, 1.5
FOLDS, HELD = 7, 2
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_states bigint, longest_state bigint"
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_states", pa.int64()), ("longest_state", pa.int64())]
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Log probabilities are sent in steps of a nat.
_STEPS = 2048
#: Bits of a continuation's hash.
_SYMBOL = 32
#: The first rounds read whole blocks, then one in so many; the others only what the live positions can reach until then.
_WHOLE, _STRIDE = 3, 8


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, pa.Array]]:
    """Documents by some MB: their ids, how many words each has, and the words one after the other."""
    for b in batches:
        texts = pc.ascii_trim_whitespace(pc.fill_null(b.column("text"), ""))
        size = np.asarray(pc.binary_length(texts)).astype(np.int64)
        cuts = np.searchsorted(np.cumsum(size) // SLICE, np.arange(1 + int(size.sum()) // SLICE + 1))
        for at, to in zip(cuts, cuts[1:]):
            if to > at:
                lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[at:to]))
                counts, words = np.asarray(pc.list_value_length(lists)).astype(np.int64), lists.flatten()
                if not size[at:to].all():  # an empty text is split into an empty word
                    counts, words = np.where(size[at:to] > 0, counts, 0), words.filter(pc.greater(pc.binary_length(words), 0))
                yield b.column("doc_id")[at:to].to_pylist(), counts, words


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> blocks: ids, held-out flags, lengths, tokens as the block's word numbers, the words' hashes. Word 0 is
    the end, whose hash is 0."""
    out = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
    pid, k = TaskContext.get().partitionId(), 0
    ids: list = []
    sizes: list[np.ndarray] = []
    parts: list[pa.Array] = []
    held = 0

    def block() -> pa.RecordBatch:
        counts, coded = np.concatenate(sizes), pa.concat_arrays(parts).dictionary_encode()
        inner = np.ones(len(coded) + len(counts), bool)
        inner[np.cumsum(counts + 1) - 1] = False
        tokens = np.zeros(len(inner), np.uint32)
        tokens[inner] = coded.indices.to_numpy().view(np.uint32) + np.uint32(1)
        planes = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T[: 3 if len(coded.dictionary) < 1 << 24 else 4])
        one = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        two = word_hashes(pc.binary_join(one, "\n")[0].as_buffer()) if len(coded.dictionary) else np.zeros((0, 2), np.uint64)
        hashes = two[:, 0].copy(), two[:, 1].astype(np.uint16)
        return batch(out, [[pid << 32 | k], [exchange.pack(ids, np.array([held_out(i) for i in ids]), counts + 1, planes, *hashes)]])

    for some, counts, words in _split(batches):
        at = before = 0
        while at < len(some):
            full = held + np.cumsum(counts[at:] + 1)
            to = min(len(some), at + 1 + int(np.searchsorted(full, BLOCK)))
            n = int(counts[at:to].sum())
            ids, held = ids + some[at:to], int(full[to - at - 1])
            sizes.append(counts[at:to])
            parts.append(words[before : before + n])
            at, before = to, before + n
            if held >= BLOCK:
                yield block()
                ids, sizes, parts, held, k = [], [], [], 0, k + 1
    if ids:
        yield block()


def word_hashes(joined: bytes | pa.Buffer) -> np.ndarray:
    """Two 64-bit hashes of each of some words, joined by line ends: sums of mixed (place, byte) pairs, mixed with the
    length. Whole arrays at a time, which is much faster than a call for each word."""
    raw = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = (ends - starts).astype(np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts, np.append(np.diff(starts), len(raw) - starts[-1]))
    pair = place.astype(np.uint64) << np.uint64(8) | raw
    out = np.empty((len(starts), 2), np.uint64)
    for k, odd in enumerate((_ODD, np.uint64(0xC2B2AE3D27D4EB4F))):
        x = mix64((pair + np.uint64(1)) * odd)
        x[ends[:-1]] = 0
        out[:, k] = mix64(np.add.reduceat(x, starts) + n * odd)
    return out


def _bounds(buckets: int, bits: int = 64) -> list[np.uint64]:
    return [np.uint64((k << bits) // buckets) for k in range(1, buckets)]


def _narrow(x: np.ndarray, width: int) -> bytes:
    """Unsigned numbers in so many bytes each."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widened(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def _rounded(p: np.ndarray) -> np.ndarray:
    """Probabilities with the 28 bits that are kept between rounds."""
    return ((p.view(np.uint64) + np.uint64(1 << 23)) >> np.uint64(24) << np.uint64(24)).view(np.float64)


def judged(n: np.ndarray, t: np.ndarray, r: np.ndarray, a: np.ndarray, c: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether contexts are states, and whether longer ones may be as well. n: occurrences, t: different continuations; over
    the repeated continuations w, r: sum of n(w), a: sum of n(w) (ln n(w) - ln P(w | s')), c: sum of n(w) ln n(w), high:
    most of ln n(w) - ln P(w | s'), low: least n(w)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        state = (n >= 2) & (a - r * np.log(n) >= GAIN) & (high - np.log(n) >= np.log(RATIO))
        return state, state & (r * np.log(n + t) - c >= GAIN - 1e-6) & (low * RATIO <= n + t)


#: Sums of a context's parts, then what is the most and the least of them, as judged() takes them.
_SUMS = 5


class Level:
    """The distinct (context, symbol) pairs at a block's live positions, by unit: a context, or one of the parts into
    which a large one is split by its symbols. Units are in the order in which buckets are asked."""

    def __init__(self, block: Block, depth: int, at: np.ndarray, p: np.ndarray, split: np.ndarray):
        """at: positions; p: probability of their symbol in the shorter context; split: parts of their contexts."""
        self.buckets = block.buckets
        w, wide = block.token[at], np.flatnonzero(split > 1)
        if depth == 1:  # contexts are words: there are fewer of them to be sorted than positions
            last = block.token[at - 1]
            used = np.bincount(last, minlength=len(block.hi))
            used[last[wide]] = 0
            used = np.flatnonzero(used)
            unit, large = block.word_contexts[used], block.word_contexts[last[wide]]
        else:
            unit = block.contexts(at, depth)
            large = unit[wide]
        parts = more = own = np.zeros(0, np.uint64)
        if len(wide):  # every part of such a context is asked, so that its sums are whole
            parts = mix64(large + (block.symbol[w[wide]] % split[wide].astype(np.uint64) + np.uint64(1)) * _ODD)
            _, _, one = ranked(large)
            times = split[wide[one]].astype(np.int64)
            part = np.arange(1, times.sum() + 1) - np.repeat(np.cumsum(times) - times, times)
            own = np.repeat(large[one], times)
            more = mix64(own + part.astype(np.uint64) * _ODD)
        if depth > 1:
            unit[wide] = parts
            parts = parts[:0]
        self.units, of, _ = ranked(np.concatenate((unit, parts, more)) >> np.uint64(64 - block.bits))
        of, of_parts, asked = np.split(of, [len(unit), len(unit) + len(parts)])
        if depth == 1:
            rank = np.zeros(len(block.hi), np.int64)
            rank[used] = of
            of = rank[last]
            of[wide] = of_parts
        self.unit, self.wide = of, np.unique(asked)
        self.whose = np.zeros(len(self.units), np.uint64)
        self.whose[asked] = own
        width = np.uint64(len(block.hi).bit_length())
        pair, self.pair, first = ranked(self.unit.astype(np.uint64) << width | w.astype(np.uint64))
        self.pair_unit = (pair >> width).astype(np.int64)
        self.symbol = block.symbol[(pair & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)]
        self.count = np.bincount(self.pair[block.train[at]], minlength=len(pair))
        self.lp = np.clip(np.rint(np.log(p[first]) * -_STEPS), 0, 65535).astype(np.uint16)
        self.cut = [0, *np.searchsorted(self.units, _bounds(self.buckets, block.bits)).tolist(), len(self.units)]
        self.pair_cut = np.searchsorted(self.pair_unit, self.cut).tolist()

    def _slices(self) -> Iterator[tuple[int, slice, slice, np.ndarray]]:
        for k, (a, b, x, y) in enumerate(zip(self.cut, self.cut[1:], self.pair_cut, self.pair_cut[1:])):
            if b > a:
                yield k, slice(a, b), slice(x, y), self.wide[(self.wide >= a) & (self.wide < b)]

    def asks(self) -> Iterator[tuple[int, bytes]]:
        for k, units, pairs, wide in self._slices():
            sizes = np.bincount(self.pair_unit[pairs] - units.start, minlength=units.stop - units.start)
            seen = self.count[pairs] > 0
            yield k, exchange.pack(exchange.squeeze(self.units[units]), exchange.short(sizes), exchange.small(wide - units.start), _narrow(self.symbol[pairs], _SYMBOL // 8), exchange.short(self.count[pairs]), self.lp[pairs][seen])

    def read(self, answers: dict, depth: int) -> tuple[np.ndarray, ...]:
        """For each position: n(s, w), n(s), T(s), whether s is a state, whether a longer context may be."""
        total = np.zeros(len(self.pair_unit), np.int64)
        n, t, flag = np.zeros(len(self.units), np.int64), np.zeros(len(self.units), np.int64), np.zeros(len(self.units), np.uint8)
        sums = []
        for k, units, pairs, wide in self._slices():
            totals, flags, ns, ts, parts = exchange.unpack(answers[depth, k])
            total[pairs], flag[units], n[units] = exchange.long(totals), flags, exchange.long(ns)
            t[units][flags & 1 > 0] = exchange.long(ts)
            sums.append(parts)
        if len(self.wide):
            whose, of = np.unique(self.whose[self.wide], return_inverse=True)
            columns = np.concatenate(sums).T
            whole = [np.bincount(of, x, len(whose)) for x in columns[:_SUMS]]
            for x, pick, start in ((columns[_SUMS], np.maximum, -np.inf), (columns[_SUMS + 1], np.minimum, np.inf)):
                whole.append(np.full(len(whose), start))
                pick.at(whole[-1], of, x)
            state, more = judged(*whole)
            n[self.wide], t[self.wide] = whole[0][of], whole[1][of]
            flag[self.wide] = (state + 2 * more)[of]
        u = self.unit
        return total[self.pair], n[u], t[u], flag[u] & 1 > 0, flag[u] & 2 > 0


def merge_grams(blobs: list[bytes]) -> tuple[list[bytes], None]:
    """A bucket's units: counts summed over the blocks, and what the divergence test says."""
    parts = [exchange.unpack(x) for x in blobs]
    sizes = [exchange.long(p[1]) for p in parts]
    heads, of, _ = ranked(np.concatenate([exchange.expand(p[0]) for p in parts]))
    unit = np.repeat(of, np.concatenate(sizes))
    count = np.concatenate([exchange.long(p[4]) for p in parts])
    lp = np.zeros(len(count))
    lp[count > 0] = np.concatenate([p[5] for p in parts]) / _STEPS
    key = mix64(heads[unit] + np.concatenate([_widened(p[3], _SYMBOL // 8) for p in parts]) * _ODD)
    order = sorting(key)
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[order][1:] != key[order][:-1])))
    gram = np.empty(len(key), np.int64)
    gram[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
    n = np.bincount(gram, count, len(new)).astype(np.int64)
    minus = np.maximum.reduceat(lp[order], new) if len(new) else lp  # the same from all blocks that have counts
    h, many = unit[order[new]], n >= 2
    log = np.where(many, n * np.log(np.maximum(n, 1)), 0.0)
    add = lambda x: np.bincount(h, x, len(heads))
    high, low = np.full(len(heads), -np.inf), np.full(len(heads), np.inf)
    np.maximum.at(high, h[many], np.log(n[many]) + minus[many])
    np.minimum.at(low, h[many], n[many].astype(np.float64))
    sums = np.stack([add(n), add(n > 0), add(np.where(many, n, 0)), add(log + np.where(many, n * minus, 0.0)), add(log), high, low], axis=1)
    state, more = judged(*sums.T)
    out, at, head = [], 0, 0
    for z, p in zip(sizes, parts, strict=True):
        end, last = at + int(z.sum()), head + len(z)
        u = of[head:last]
        flags = (state[u] + 2 * more[u]).astype(np.uint8)
        out.append(exchange.pack(exchange.short(n[gram[at:end]]), flags, exchange.short(sums[u, 0].astype(np.int64)), exchange.short(sums[u, 1][state[u]].astype(np.int64)), sums[u[p[2].astype(np.int64)]]))
        at, head = end, last
    return out, None


#: Positions in order, the probabilities of their symbols, the parts that their contexts are split into, and whether a
#: shorter context is a state.
Live = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Block:
    """A block's documents; words are sorted for the first exchange only."""

    def __init__(self, payload: bytes, buckets: int, total: int = 0):
        self.ids, self.held, self.lengths, planes, hi, lo, *places = exchange.unpack(payload)
        self.places = exchange.expand(places[0]).view(np.int64) if places else None
        self.hi, self.lo = np.append(np.uint64(0), hi), np.append(np.uint16(0), lo)
        self.symbol = self.hi & np.uint64((1 << _SYMBOL) - 1)
        self.buckets, self.total = buckets, total
        self.bits = min(64, total.bit_length() + 20)
        self.token = planes[0].astype(np.int32)
        for k in range(1, len(planes)):
            self.token |= planes[k].astype(np.int32) << (8 * k)
        self.first = np.cumsum(self.lengths) - self.lengths

    @cached_property
    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    @cached_property
    def word_contexts(self) -> np.ndarray:
        """Hashes of the contexts that are a word."""
        return mix64(np.uint64(1) * _ODD + self.hi)

    @cached_property
    def place(self) -> np.ndarray:
        """Words before each position in its document."""
        return np.arange(len(self.token), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.lengths)

    def sort_words(self) -> None:
        self.order = sorting(self.hi)
        hi = self.hi[self.order]
        if (hi[1:] == hi[:-1]).any():
            self.order = np.lexsort((self.lo, self.hi))
        self.cut = [0, *np.searchsorted(self.hi[self.order], _bounds(self.buckets)).tolist(), len(self.hi)]

    def ask_words(self) -> Iterator[tuple[int, bytes]]:
        self.sort_words()
        count = np.bincount(self.token[self.train], minlength=len(self.hi))[self.order]
        hi, lo = self.hi[self.order], self.lo[self.order]
        for k, (a, b) in enumerate(zip(self.cut, self.cut[1:])):
            if b > a:
                yield k, exchange.pack(exchange.squeeze(hi[a:b]), lo[a:b], exchange.short(count[a:b]))

    def read_words(self, answers: dict) -> np.ndarray:
        """Training counts of the block's words."""
        self.sort_words()
        c = np.zeros(len(self.hi), np.int64)
        for k, (a, b) in enumerate(zip(self.cut, self.cut[1:])):
            if b > a:
                c[a:b] = exchange.long(exchange.unpack(answers[0, k])[0])
        count = np.empty(len(c), np.int64)
        count[self.order] = c
        return count

    def contexts(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Hashes of the depth words before each position."""
        if depth == 1:
            return self.word_contexts[self.token[at - 1]]
        h = np.full(len(at), depth, np.uint64)
        for k in range(1, depth + 1):
            h = mix64(h * _ODD + self.hi[self.token[at - k]])
        return h

    def shortened(self, at: np.ndarray, reach: int) -> tuple[bytes, np.ndarray]:
        """A block of the stretches that hold those positions and as many as reach words before each, and the positions
        there. A stretch stands for a document: its id is the document's number, and its places in the whole block are
        kept."""
        edge = np.bincount(at - np.minimum(self.place[at], reach), minlength=len(self.token) + 1)
        edge[at + 1] -= 1
        kept = np.cumsum(edge[:-1]) > 0
        where = np.flatnonzero(kept)
        head = np.flatnonzero((self.place[where] == 0) | ~kept[where - 1])
        doc = self.doc[where[head]]
        token = self.token[where]
        used = np.zeros(len(self.hi), bool)
        used[token] = True
        used[0] = True
        words = np.flatnonzero(used)[1:]
        token = (np.cumsum(used) - 1).astype(np.uint32)[token]
        planes = np.ascontiguousarray(token.view(np.uint8).reshape(-1, 4).T[: 3 if len(words) < 1 << 24 else 4])
        owner, places = (doc, where) if self.places is None else (self.ids[doc], self.places[where])
        lengths = np.diff(np.append(head, len(where)))
        payload = exchange.pack(owner, self.held[doc], lengths, planes, self.hi[words], self.lo[words], exchange.squeeze(places))
        return payload, np.searchsorted(where, at)

    def opening(self, seen: np.ndarray, p: np.ndarray) -> Live:
        """The positions live in the first round: those after a word that occurs twice or more in training. seen: how often
        words do, p: their probabilities."""
        at = np.flatnonzero((seen >= 2)[self.token[:-1]] & (self.place[1:] > 0)) + 1
        split = 1 + (4 * self.buckets * seen) // max(1, self.total)
        return at, _rounded(p)[self.token[at]], split[self.token[at - 1]], np.zeros(len(at), bool)

    def longer(self, depth: int, at: np.ndarray, p: np.ndarray, inside: np.ndarray, total: np.ndarray, n: np.ndarray, more: np.ndarray) -> Live:
        """The positions live at the next depth. total: how often the symbol follows; that of the position before is the
        count of the next context, where it was live."""
        before = np.full(len(self.token) + 1, -1, np.int64)
        before[at + 1] = total
        of = np.flatnonzero(more)
        at, n = at[of], n[of]
        last = before[at]
        most = np.where(last >= 0, np.minimum(last, n), n)
        keep = np.flatnonzero((most >= 2) & (self.place[at] > depth))
        of = of[keep]
        return at[keep], _rounded(p[of]), 1 + (4 * self.buckets * most[keep]) // max(1, self.total), inside[of]


def _merge_words(blobs: list[bytes]) -> tuple[list[bytes], bytes]:
    parts = [exchange.unpack(x) for x in blobs]
    hi, lo = np.concatenate([exchange.expand(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    n = np.concatenate([exchange.long(p[2]) for p in parts])
    order = np.lexsort((lo, hi))
    new = np.concatenate(([True], (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])))
    group = np.empty(len(hi), np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group, n).astype(np.int64)
    ends = np.cumsum([p[0][0] for p in parts])[:-1]
    return [exchange.pack(exchange.short(x)) for x in np.split(total[group], ends)], exchange.pack(int(total.sum()), int((total > 0).sum()))


def _state(length: int, sums: list[np.ndarray], live: Live) -> bytes:
    """A block of so many tokens between rounds: sums by document, and the live positions with what is known of them."""
    at, p, split, inside = live
    mask = np.zeros(length if len(at) else 0, bool)
    mask[at] = True
    return exchange.pack(sums, len(mask), np.packbits(mask), _narrow(p.view(np.uint64) >> np.uint64(24), 5), exchange.short(split - 1), np.packbits(inside))


def _resumed(blob: bytes) -> tuple[list[np.ndarray], Live]:
    sums, length, mask, p, split, inside = exchange.unpack(blob)
    p = (_widened(p, 5) << np.uint64(24)).view(np.float64)
    return sums, (np.flatnonzero(np.unpackbits(mask, count=length)), p, 1 + exchange.long(split), np.unpackbits(inside, count=len(p)) > 0)


def score(docs: DataFrame) -> DataFrame:
    """Base and tree score of each document, learned from those whose crc32(doc_id) mod FOLDS is not HELD; n_states: tokens
    scored in a state, longest_state: words of the longest."""
    buckets = partitions(docs.sparkSession)
    held = [bucketed(text_of(docs).mapInArrow(_encode, "block bigint, payload binary"), "blocks", "block", buckets)]
    try:
        return _scored(held, buckets)
    finally:
        release(*held)


def _scored(held: list[DataFrame], buckets: int) -> DataFrame:
    """held: the blocks, and tables to be released at the end, come what may."""
    blocks = held[0]
    words = materialise(exchange.answered(exchange.asked(blocks, lambda _, p: list(Block(p, buckets).ask_words()), 0), _merge_words), "words")
    held.append(words)
    told = [exchange.unpack(r["blob"]) for r in words.where("block = -1").select("blob").collect()]
    n, v = sum(x[0] for x in told), sum(x[1] for x in told)

    def whole(depth: int) -> bool:
        """Whether the round reads whole blocks."""
        return depth <= _WHOLE or (depth - _WHOLE) % _STRIDE == 0

    def opened(payload: bytes, answers: dict, depth: int) -> tuple[Block, list[np.ndarray], Live]:
        """A block as the rounds before depth have left it; before the first these are the words' counts."""
        block = Block(payload, buckets, n)
        if depth > 1:
            return block, *_resumed(answers[-1, -1])
        seen = block.read_words(answers)
        each = (seen + 1) / (n + 1 * (v + 1))
        base, none = np.add.reduceat(np.log10(each)[block.token], block.first), np.zeros(len(block.first), np.int64)
        known = np.add.reduceat((seen > 0).astype(np.int64)[block.token], block.first)
        return block, [base, known, base, none, none], block.opening(seen, each)

    def over(answers: dict, depth: int) -> bool:
        """Whether nothing in the block is live any more."""
        return depth > 1 and not len(_resumed(answers[-1, -1])[1][0])

    def asking(depth: int) -> Callable[[int, bytes, dict], pa.Table]:
        def ask(number: int, payload: bytes, answers: dict) -> pa.Table:
            if number < 0 or over(answers, depth):
                return exchange.messages([])
            block, _, live = opened(payload, answers, depth)
            return exchange.messages([(number, k, depth, x) for k, x in Level(block, depth, *live[:3]).asks()] if len(live[0]) else [])

        return ask

    def kept(number: int, stretches: bytes, blob: bytes) -> pa.Table:
        return pa.table([pa.array([number], pa.int64()), pa.array([stretches], pa.binary()), pa.array([blob], pa.binary())], names=["block", "payload", "own"])

    def reading(depth: int) -> Callable[[int, bytes, dict], pa.Table]:
        def read(number: int, payload: bytes, answers: dict) -> pa.Table:
            if number < 0:
                return kept(number, b"", b"").slice(1)
            if over(answers, depth):
                return kept(number, b"", answers[-1, -1])
            block, sums, (at, p, split, inside) = opened(payload, answers, depth)
            base, known, now, states, longest = sums
            live = at, p, split, inside
            if len(at):
                total, ns, t, state, more = Level(block, depth, at, p, split).read(answers, depth)
                of, new = np.flatnonzero(state), p.copy()
                new[of] = (total[of] + t[of] * p[of]) / np.maximum(ns[of] + t[of], 1)
                doc = block.doc[at[of]] if block.places is None else block.ids[block.doc[at[of]]]
                now = now + np.bincount(doc, np.log10(new[of] / p[of]), len(base))
                states = states + np.bincount(doc, ~inside[of], len(base)).astype(np.int64)
                longest = np.where(np.bincount(doc, minlength=len(base)) > 0, depth, longest)
                live = block.longer(depth, at, new, inside | state, total, ns, more)
            stretches, length = b"", len(block.token)
            if len(live[0]) and not whole(depth + 1):
                stretches, there = block.shortened(live[0], depth + _STRIDE - (depth - _WHOLE) % _STRIDE)
                live, length = (there, *live[1:]), int(there[-1]) + 1
            elif block.places is not None:
                live, length = (block.places[live[0]], *live[1:]), int(block.places[-1]) + 1
            return kept(number, stretches, _state(length, [base, known, now, states, longest], live))

        return read

    def finishing(depth: int) -> Callable[[int, bytes, dict], pa.Table]:
        def finish(number: int, payload: bytes, answers: dict) -> pa.Table:
            if number < 0:
                return _OUT.empty_table()
            block, (base, known, now, states, longest), _ = opened(payload, answers, depth)
            columns = [block.ids, block.held, block.lengths, known, np.full(len(base), n), base, now, states, longest]
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

        return finish

    # the first round starts from the words' counts, the others from what the blocks have kept
    with_words = words.where("block >= 0")
    now, own, depth = blocks, blocks, 1
    while True:
        run = lambda of, finish, schema: exchange.concluded(of, with_words, finish, schema) if depth == 1 else exchange.alone(of, finish, schema)  # noqa: B023, E731
        answers = materialise(exchange.answered(run(now, asking(depth), exchange.MESSAGE), merge_grams), "answers")
        held.append(answers)
        if answers.isEmpty():
            return materialise(run(now if depth == 1 else blocks.join(own.select("block", "own").hint("merge"), "block"), finishing(depth), SCHEMA), "scores")
        own = bucketed(exchange.concluded(now, answers.union(with_words) if depth == 1 else answers, reading(depth), "block bigint, payload binary, own binary"), "own", "block", buckets)
        release(*held[1:])
        held[1:] = [own]
        depth += 1
        now = blocks.join(own.select("block", "own").hint("merge"), "block") if whole(depth) else own
