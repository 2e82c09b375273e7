"""Exact SentencePiece BPE ids and their decoding [operator 7], by a prefix table.

For byte-pair merging, every prefix of a text has one encoding, and its last token is the one vocabulary match ending
there that is compatible with the last token of the prefix before it. An automaton over the vocabulary gives the
matches, a pair test (remembered) the compatibility, and the table of last tokens is walked backwards for the ids.
Pieces hold a word mark only at their start and no line end, so a text is cut at both, and a segment's ids are
remembered by the worker up to a limit.

Cases: a null text counts as empty and has the end id alone, decoded to the empty text; ids may be null or repeated;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from cairn.llm.common import batch, text_of

DEFAULT = "piece_bpe_32k.model"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceBpe:
    """The model's pieces and scores are read from its file; its normaliser must be the identity, with a leading mark
    and byte fallback, else this algorithm does not apply."""

    def __init__(self, file: str, limit: int = 800_000):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=file)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.processor.serialized_model_proto())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not train.byte_fallback or train.model_type != 2 or train.treat_whitespace_as_suffix:
            raise ValueError("the model's normaliser or type is not one that this algorithm covers")
        self.piece = [p.piece for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces) or any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("the vocabulary has pieces that cross words")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        #: Neighbouring characters within some piece: no merge ever joins others.
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.singles = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.limit = limit
        self.fits: dict[tuple[str, str], bool] = {}
        self.marked, self.bare = _Segments(self, MARK), _Segments(self, "")
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def merge(self, text: str) -> list[str]:
        """The definition: the adjacent pair whose union scores highest, leftmost first, is merged again and again."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) >= self.limit:
                self.fits.clear()
            got = self.fits[left, right] = left[-1] + right[0] not in self.inside or self.merge(left + right) == [left, right]
        return got

    def apart(self, segment: str) -> list[str]:
        """The segment cut where no piece has both neighbours."""
        cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in self.inside]
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)])] if cuts else [segment]

    def tokens(self, segment: str) -> list[str]:
        """The segment's pieces; a character outside the vocabulary is a piece by itself, compatible with any."""
        n = len(segment)
        last: list[str | None] = [None] * (n + 1)
        known = self.singles
        if not known.issuperset(segment):
            for k, c in enumerate(segment):
                if c not in known:
                    last[k + 1] = c
        get = self.fits.get
        for end, piece in self.automaton.iter(segment):  # by their ends, so what is before a match is settled
            if last[end + 1] is not None:
                continue
            start = end + 1 - len(piece)
            if start:
                before = last[start]
                if before is None:
                    continue
                fits = get((before, piece))
                if fits or fits is None and self.compatible(before, piece):
                    last[end + 1] = piece
            elif len(piece) == 1 or self.alone(piece):
                last[end + 1] = piece
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def alone(self, piece: str) -> bool:
        """Whether merging makes the piece from its own characters."""
        got = self.fits.get((piece, ""))
        if got is None:
            got = self.fits[piece, ""] = self.merge(piece) == [piece]
        return got

    def ids_of(self, segment: str) -> list[int]:
        out: list[int] = []
        for t in self.tokens(segment):
            i = self.id.get(t)
            out += [i] if i is not None else [self.byte[b] for b in t.encode("utf-8", "replace")]
        return out

    def text_of(self, ids: list[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8 (each wrong byte a replacement mark), marks to spaces."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i is not None:
                out.append(self.piece[i])
        return "".join(out).replace(MARK, " ")

    def encode(self, text: str | None) -> tuple[str, str]:
        """The ids in decimal, joined by spaces (with no end id), and the decoded text."""
        if not text:
            return "", ""
        out, back = [], []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
                back.append("\n")
            parts = line.split(" ")
            if MARK in line or "" in parts[:-1]:
                for s in self.cut.findall((line if k else " " + line).replace(" ", MARK)):
                    got = self.bare[s] if s[0] != MARK else self.marked[s[1:]]
                    out.append(got[0])
                    back.append(got[1])
                continue
            got = self.bare[parts[0]] if k else self.marked[parts[0]]
            rest = list(map(self.marked.__getitem__, parts[1:]))
            out.append(got[0])
            back.append(got[1])
            out.extend([g[0] for g in rest])
            back.extend([g[1] for g in rest])
        return " ".join(filter(None, out)), "".join(back)[1:]

    @property
    def newline(self) -> str:
        return self.bare["\n"][0]


class _Segments(dict):
    """Segment (without its leading mark) -> its ids in decimal and its decoded text."""

    def __init__(self, model: PieceBpe, lead: str):
        super().__init__()
        self.model, self.lead = model, lead

    def __missing__(self, segment: str) -> tuple[str, str]:
        if len(self) >= self.model.limit:
            self.clear()
        parts = self.model.apart(self.lead + segment) if not segment.isalpha() else ()
        if len(parts) > 1:
            m = self.model
            found = [m.marked[p[1:]] if p[0] == MARK else m.bare[p] for p in parts]
            # bytes of one character never lie in two parts, so the decoded texts join
            got = (" ".join([f[0] for f in found]), "".join([f[1] for f in found]))
        else:
            ids = self.model.ids_of(self.lead + segment)
            got = (" ".join(map(str, ids)), self.model.text_of(ids))
        self[segment] = got
        return got


_made: dict[str, PieceBpe] = {}


def pieces(file: str) -> PieceBpe:
    if file not in _made:
        _made[file] = PieceBpe(file)
    return _made[file]


def encode(docs: DataFrame, file: str | None = None) -> DataFrame:
    """Number and digest of each text's ids (an end id last), and the digest of the ids' decoding."""
    file = file or public_tokenizers.path(DEFAULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(file)
        end = str(model.processor.eos_id())
        for b in batches:
            n, ids, back = [], [], []
            for text in b.column("text").to_pylist():
                got, decoded = model.encode(text)
                got = f"{got} {end}" if got else end
                n.append(got.count(" ") + 1)
                ids.append(hashlib.sha256(got.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield batch(_OUT, [b.column("doc_id"), n, ids, back])

    return text_of(docs).mapInArrow(run, SCHEMA)
