"""Exact tokenizer output at word-cache speed.

The vocabulary's rules never join characters across ASCII white space: normalisation works on single
characters, white space is dropped and pieces are matched between it. So the ids of a text are the ids of its
white-space-delimited words, one after the other, and each distinct word need be encoded only once.
"""

from __future__ import annotations

import os
from array import array

#: Words kept per Python worker, and bases (below); about 150 bytes each. When full, a cache starts anew.
CACHE_WORDS, CACHE_BASES = 300_000, 400_000
#: One of these after a letter is a piece of its own.
ENDS = ".,;:!?"
#: Byte-level alphabet, fixed by the vocabulary's format: bytes without a printable Latin-1 character move up to 256 and on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(_HIDDEN)}
_ENCODERS: dict[str, "WordEncoder"] = {}


def _ids(values: list[int]) -> bytes:
    return array("I", values).tobytes()


class WordEncoder(dict):
    """Encodes UTF-8 texts to ids held as little-endian unsigned 32-bit integers.

    A word of Latin letters, with at most one of ENDS after it, is a base that needs no normaliser but
    lower-casing: it goes to the model at once, and all its spellings share that work. Any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ends = {c: _ids(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in ENDS}
        self.bases: dict[str, bytes] = {}

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = raw.decode()
        tail = self.ends.get(word[-1], b"")
        base = word[:-1] if tail else word
        if not (base.isalpha() and max(base) < "\u0180" and "\u0130" not in base):
            ids = self[raw] = _ids(self.tokenizer.encode(word, add_special_tokens=False).ids)
            return ids
        base = base.lower()
        ids = self.bases.get(base)
        if ids is None:
            if len(self.bases) >= CACHE_BASES:
                self.bases.clear()
            level = base if base.isascii() else base.encode().decode("latin-1").translate(_BYTE_LEVEL)
            ids = self.bases[base] = _ids([t.id for t in self.model.tokenize(level)])
        ids = self[raw] = ids + tail
        return ids

    def encode(self, raws: list[bytes | None], end_id: int) -> list[bytes]:
        """One bytes object per text: its ids, then ``end_id``. Null counts as empty."""
        end, get = end_id.to_bytes(4, "little"), self.__getitem__
        return [b"".join(map(get, raw.split())) + end if raw else end for raw in raws]


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; it lives as long as the worker does."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
