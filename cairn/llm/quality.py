"""Quality rules by distribution divergence [operator 9].

A document's histogram of character classes, and that of its language's common words, are compared with references by
the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). References are learned from the whole
corpus: each language's class histogram is the per-document mean, and its word histogram the summed counts, over all of
its documents. A verdict needs a minimum length: below it the distances say little and only the base rules decide.

Cases: a null text has no words and fails the base rules; a null language, one without a list of common words and one
without a reference are told the distances to that whose common words are nearest (then the nearest classes, then the first
in COMMON), but such a document is judged by it only if its words say that it is in that language (a word distance within
the limit): then by its classes. Texts in other languages are left to the base rules. Ids may be null or repeated; an empty
table gives no rows; other columns pass by; texts are read whole, very long ones too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batch, frugal

#: Common words by language.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by are this at from or an not have".split(),
    "fr": "de la le et les en des un du une que est pour par dans avec qui pas sur au ne il se plus".split(),
    "de": "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als auch es an".split(),
    "es": "de la que el en y los las se del un por con no una su para es al lo como más o pero".split(),
}
#: Character classes: lower-case, upper-case, other letters, digits, white space, sentence marks, symbols, the rest.
CLASSES = ("lower", "upper", "letter", "digit", "space", "mark", "symbol", "rest")
_MARKS, SYMBOLS, _SPACE = ".,;:!?'\"()-", "#*$%&|<>", " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Documents of fewer words are not judged by distance.
MIN_JUDGED = 100
#: Distances above these reject: of character classes, of common words.
MAX_CLASS, MAX_WORDS = 0.30, 0.30
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double"
)
_OUT = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
)


def _class(c: int) -> int:
    x = chr(c)
    if x in _SPACE:
        return 4
    if x in _MARKS:
        return 5
    if x in SYMBOLS:
        return 6
    return 0 if x.islower() else 1 if x.isupper() else 2 if x.isalpha() else 3 if x.isdigit() else 7


_TABLE = np.array([_class(c) for c in range(0x10000)], np.uint8)


def classes(text: str) -> np.ndarray:
    """How many characters of each class."""
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points < 0x10000, points, 0xFFFF)
    return np.bincount(_TABLE[points], minlength=len(CLASSES))


_INDEX = {lang: {w: k for k, w in enumerate(ws)} for lang, ws in COMMON.items()}


def common(lowered: list[str], lang: str) -> np.ndarray:
    """Counts of the language's common words, and of all other words last."""
    index = _INDEX[lang]
    out = np.zeros(len(index) + 1)
    hits = Counter(filter(index.__contains__, lowered))
    for w, n in hits.items():
        out[index[w]] = n
    out[-1] = len(lowered) - out[:-1].sum()
    return out


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance with base-2 logarithms; 1 if either has no mass."""
    a, b = float(p.sum()), float(q.sum())
    if not a or not b:
        return 1.0
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return math.sqrt(max(0.0, float(d) / 2))


def base(text: str) -> tuple[list[str], int, int, int, int]:
    """Words (between ASCII white space), their characters, symbols, repeated lines, words in repeated 3-word windows."""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    n = len(ws)
    n_space = sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        a = np.fromiter([ids.setdefault(w, len(ids)) for w in ws], np.int64, n)
        v = len(ids)
        if v < 2_000_000:
            key = (a[:-2] * v + a[1:-1]) * v + a[2:]
        else:
            pair = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)[1]
            key = pair * v + a[2:]
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(key) + 2, bool)
        at = np.zeros(len(key), bool)
        at[order[1:][same]] = True
        at[order[:-1][same]] = True
        twice[:-2] |= at
        twice[1:-1] |= at
        twice[2:] |= at
        repeat = int(twice.sum())
    return ws, len(text) - n_space, symbols, len(lines) - len(set(lines)), repeat


def _lowered(ws: list[bytes]) -> list[str]:
    return [w.strip(b".,;:!?") for w in b"\n".join(ws).lower().split(b"\n")] if ws else []


_BYTES_INDEX = {lang: {w.encode(): w for w in ws} for lang, ws in COMMON.items()}


def histograms(text: str, ws: list[bytes], langs: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    low = _lowered(ws)
    out = {}
    for lang in langs:
        names = _BYTES_INDEX[lang]
        out[lang] = common([names.get(w, "") for w in low], lang)
    return classes(text), out


_REF = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("k", pa.int32()), ("n", pa.float64())])


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each language's class and common-word histogram over all its documents of MIN_JUDGED words or more. The result
    is a few numbers for each language; counts are summed in the tasks before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if not text or lang not in COMMON:
                    continue
                ws = text.encode("utf-8", "surrogatepass").split()
                if len(ws) < MIN_JUDGED:
                    continue
                c, w = histograms(text, ws, [lang])
                got = sums.setdefault(lang, [np.zeros(len(CLASSES)), np.zeros(len(COMMON[lang]) + 1)])
                # millionths, as whole numbers: their sum does not depend on the tasks' order
                got[0] += np.round(1e6 * c / c.sum())
                got[1] += w[lang]
        rows = [(lang, kind, k, float(n)) for lang, got in sums.items() for kind in (0, 1) for k, n in enumerate(got[kind])]
        yield batch(_REF, list(zip(*rows, strict=True)) or [[]] * 4)

    found = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, kind int, k int, n double")
    out = {lang: (np.zeros(len(CLASSES)), np.zeros(len(ws) + 1)) for lang, ws in COMMON.items()}
    for r in found.groupBy("lang", "kind", "k").agg(F.sum("n").alias("n")).collect():
        out[r["lang"]][r["kind"]][r["k"]] = r["n"]
    return {lang: x for lang, x in out.items() if x[0].sum()}


def verdict(n_words: int, class_distance: float, word_distance: float, own: bool = True) -> bool:
    """Whether a document that passed the base rules is kept; own: the distances are to its own language's references, not to
    the nearest."""
    if n_words < MIN_JUDGED or not own and word_distance > MAX_WORDS:
        return True
    return class_distance <= MAX_CLASS and word_distance <= MAX_WORDS


def _judged(text: str, lang: str | None, refs: dict) -> tuple:
    """The base counts, whether the base rules fail, the verdict, and both distances (1 where there is no text)."""
    ws, chars, symbols, lines, repeat = base(text)
    n = len(ws)
    failed = n < MIN_WORDS or 100 * repeat > 50 * n
    langs = [lang] if lang in refs else list(refs)
    dc = dw = 1.0
    if text and langs:
        c, w = histograms(text, ws, langs)
        dw, dc = min((distance(w[x], refs[x][1]), distance(c, refs[x][0])) for x in langs)
    return n, chars, symbols, lines, repeat, failed, not failed and (not langs or verdict(n, dc, dw, lang in refs)), dc, dw


def judge(docs: DataFrame) -> DataFrame:
    """The base counts, the verdict and both distances for each document (columns doc_id, text, lang)."""
    shared = frugal(docs).sparkSession.sparkContext.broadcast(references(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for b in batches:
            rows = [(i, *_judged(text or "", lang, refs)) for i, text, lang in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
            yield batch(_OUT, list(zip(*rows, strict=True)) or [[]] * 10)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that judge() rejects. Nothing is shuffled."""
    shared = frugal(docs).sparkSession.sparkContext.broadcast(references(docs))

    @F.pandas_udf("boolean")
    def kept(text, lang):  # noqa: ANN001, ANN202
        import pandas as pd

        refs = shared.value
        return pd.Series([bool(_judged(t or "", g, refs)[6]) for t, g in zip(text, lang, strict=True)], dtype=bool)

    return docs.where(kept(F.col("text").cast("string"), F.col("lang").cast("string")))
