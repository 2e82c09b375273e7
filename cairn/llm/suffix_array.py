"""Suffix arrays by induced sorting, and permuted common prefixes, over NumPy arrays.

Suffixes are classified as S (smaller than the next) or L. The leftmost S suffixes of each rise (LMS) are sorted by
their substrings in one induced pass, named, and, where names repeat, ordered by sorting the string of names; a second
induced pass gives the suffix array. A pass goes through the buckets of the alphabet; within a bucket whole groups of
suffixes induce their predecessors at once, which keeps the order of the scan one by one and the work linear.

The string of names has a large alphabet, for which passes bucket by bucket would be slow in Python; it is sorted by
doubling of ranks instead when its alphabet has more than WIDE names.
"""

from __future__ import annotations

import numpy as np

from cairn.llm.common import sorting

WIDE = 256


def _kinds(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S. The end counts as smaller than every symbol."""
    n = len(s)
    differs = np.empty(n, bool)
    differs[:-1] = s[1:] != s[:-1]
    differs[-1] = True
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the end of each run of equal symbols
    rises = np.zeros(n, bool)
    rises[:-1] = s[1:] > s[:-1]
    return rises[at]


def _spread(preds: np.ndarray, symbols: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Append preds to the queues of their symbols, in order."""
    if not len(preds):
        return
    order = np.argsort(symbols.astype(np.uint8 if len(queues) <= 256 else np.uint16), kind="stable")  # by radix
    symbols, preds = symbols[order], preds[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    starts = [0, *cuts.tolist(), len(preds)]
    for a, b in zip(starts, starts[1:]):
        queues[symbols[a]].append(preds[a:b])


def _induce(s: np.ndarray, kind: np.ndarray, lms: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From the LMS suffixes in order: each bucket's L suffixes and S suffixes, sorted."""
    none = np.zeros(0, np.int64)
    first: list[list[np.ndarray]] = [[] for _ in range(k)]
    _spread(lms, s[lms], first)
    smalls = [np.concatenate(x) if x else none for x in first]
    n = len(s)

    def passed(symbols: range, seeds: list[np.ndarray], queues: list[list[np.ndarray]], want: bool) -> list[np.ndarray]:
        out: list[np.ndarray] = [none] * k
        for c in symbols:
            done, now = [], queues[c]
            while now:
                cur = now[0] if len(now) == 1 else np.concatenate(now)
                done.append(cur)
                preds = cur[cur > 0] - 1
                preds = preds[kind[preds] == want]
                sym = s[preds]
                here = sym == c
                now = [preds[here]] if here.any() else []
                _spread(preds[~here], sym[~here], queues)
            out[c] = np.concatenate(done) if done else none
            seed = seeds[c]
            if len(seed):
                preds = seed[seed > 0] - 1
                preds = preds[kind[preds] == want]
                _spread(preds, s[preds], queues)
        return out

    queues: list[list[np.ndarray]] = [[] for _ in range(k)]
    if not kind[n - 1]:
        queues[s[n - 1]].append(np.array([n - 1], np.int64))
    larges = passed(range(k), smalls, queues, False)
    queues = [[] for _ in range(k)]
    small = passed(range(k - 1, -1, -1), [x[::-1] for x in larges], queues, True)
    return larges, [x[::-1] for x in small]


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names by doubling of ranks; the names are the first ranks."""
    n = len(names)
    rank, step = names.astype(np.int64) + 1, 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:]
        order = sorting(key)
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], sorted_[1:] != sorted_[:-1])))
        rank = new
        if rank[order[-1]] == n:
            return order
        step *= 2
        if step >= n:
            return order


def suffix_array(s: np.ndarray, k: int = 256) -> np.ndarray:
    """The starts of the suffixes of s (symbols below k) in order; the end is smaller than every symbol."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    kind = _kinds(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = kind[1:] & ~kind[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms):
        _, smalls = _induce(s, kind, lms, k)
        order = np.concatenate(smalls)
        order = order[is_lms[order]]
        # equal substrings, from one LMS to the next inclusive, get equal names
        after = np.append(lms[1:], n - 1)
        length = np.zeros(n, np.int64)
        length[lms] = after - lms + 1
        a, b = order[:-1], order[1:]
        equal = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
        live, j = np.flatnonzero(equal), 0
        while len(live):
            live = live[j < length[a[live]]]
            bad = s[a[live] + j] != s[b[live] + j]
            equal[live[bad]] = False
            live = live[~bad]
            j += 1
        names = np.empty(n, np.int64)
        names[order] = np.concatenate(([0], np.cumsum(~equal)))
        reduced, top = names[lms], int(names[order[-1]]) + 1
        if top == len(lms):
            lms = order
        elif top <= WIDE:
            lms = lms[suffix_array(reduced, top)]
        else:
            lms = lms[_doubled(reduced)]
    larges, smalls = _induce(s, kind, lms, k)
    return np.concatenate([x for c in range(k) for x in (larges[c], smalls[c])])


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """p[i]: the longest common prefix of suffix i and the one before it in order. Where the symbols before the two are
    equal it is one less than p[i - 1]; only the rest are compared, by words of eight bytes. s is of bytes."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    before = (i > 0) & (phi > 0)
    reducible = np.zeros(n, bool)
    reducible[before] = s[i[before] - 1] == s[phi[before] - 1]
    wide = np.concatenate((s.astype(np.uint8), np.zeros(16, np.uint8)))
    word = np.lib.stride_tricks.as_strided(wide, (n + 8, 8), (1, 1))
    p = np.zeros(n, np.int64)
    live = np.flatnonzero(~reducible & (phi >= 0))
    a, b = live.copy(), phi[live]
    while len(live):
        x = np.ascontiguousarray(word[a]).view(">u8").ravel() ^ np.ascontiguousarray(word[b]).view(">u8").ravel()
        same = x == 0
        if not same.all():
            # leading equal bytes of the first word that differs
            y = x[~same].astype(np.float64)
            bits = 63 - np.floor(np.log2(np.maximum(y, 1))).astype(np.int64)
            bits = np.clip(bits, 0, 63)
            lead = bits // 8
            # log2 of a rounded value may be one too high at a power of two: look at the byte itself
            t = x[~same]
            lead = np.where((lead < 7) & ((t >> np.minimum(56 - 8 * lead, 56).astype(np.uint64)) == 0), lead + 1, lead)
            p[live[~same]] += lead
        live, a, b = live[same], a[same] + 8, b[same] + 8
        p[live] += 8
        ends = np.maximum(a, b) >= n
        live, a, b = live[~ends], a[~ends], b[~ends]
    p = np.minimum(p, np.where(phi >= 0, n - np.maximum(i, phi), 0))
    anchor = np.maximum.accumulate(np.where(reducible, -1, i))
    return np.where(reducible, p[anchor] - (i - anchor), p)
