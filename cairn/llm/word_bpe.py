"""Exact token ids of a lower-casing word BPE vocabulary, by remembered pieces of text.

White space never lies inside a pre-token of such a vocabulary, so a text's ids are the concatenated ids of its
white-space-separated chunks. Chunks are looked up in two tiers: a table of frequent ones (broadcast), then a worker's
own cache, and only what both lack is encoded by the library. Texts with characters outside a plain set, on which the
library's Unicode tables could differ from Python's, and texts with special-token strings are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import public_tokenizers

DEFAULT = "word_bpe_49k.json"
#: ASCII without odd controls, Latin-1 and Latin Extended-A letters without dotted I, common typographic marks.
_ODD = re.compile("[^\t-\r\x20-\x7e¿-ÖØ-öø-įĲ-ňŊ-ž–—‘’“”…]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


def path(name: str = DEFAULT) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


class _Chunks(dict):
    """Chunk -> its ids' bytes, or how many ids; what is missing is merged by the library's model, one pre-token at a
    time, and remembered up to a limit. The frequent chunks are never forgotten."""

    def __init__(self, tokenizer, frequent: dict, lengths: bool, limit: int):
        super().__init__(frequent)
        self.model = tokenizer.model
        self.merge, self.frequent, self.lengths, self.limit = self.model.tokenize, frequent, lengths, limit

    def __missing__(self, chunk: str):
        if len(self) >= self.limit + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        ascii_only = chunk.isascii()
        ids = [t.id for p in _PIECE.findall(chunk) for t in self.merge(p if ascii_only else p.encode().decode("latin-1").translate(_LETTERS))]
        got = self[chunk] = len(ids) if self.lengths else array("I", ids).tobytes()
        return got


class WordBpe:
    """lengths: remember only how many ids a chunk has. limit: chunks that a worker remembers besides the frequent."""

    def __init__(self, file: str, frequent: dict | None = None, lengths: bool = False, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = _Chunks(self.tokenizer, frequent or {}, lengths, limit)

    def plain(self, text: str) -> bool:
        return not _ODD.search(text) and not any(s in text for s in self.special)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self.plain(text):
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return array("I", self._library(text)).tobytes()

    def count(self, text: str | None) -> int:
        """Number of ids (for an encoder made with lengths=True)."""
        if not text:
            return 0
        if self.plain(text):
            return sum(map(self.chunks.__getitem__, text.lower().split()))
        return len(self._library(text))


_made: dict = {}


def encoder(file: str, lengths: bool = False, table_id: str = "", frequent: dict | None = None) -> WordBpe:
    """One encoder for each worker process and table; workers are reused, so the caches live on between tasks."""
    key = (file, lengths)
    if key not in _made or _made[key][0] != table_id:
        _made[key] = (table_id, WordBpe(file, frequent, lengths))
    return _made[key][1]
