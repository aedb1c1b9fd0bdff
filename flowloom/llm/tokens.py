"""Token ids of whole texts by the tokenizers library, with a cache of what is already encoded.

A text is cut where the tokenizer's own pre-tokenizer cuts it as well, so the ids of the pieces, one
after another, are the ids of the whole text. Corpora repeat words, so most pieces come from the cache
and the others go through the library's model. Texts with letters on which Unicode versions could
differ are cut at white space only, and those of their words go through the whole library.
"""

from __future__ import annotations

import os
import re
import unicodedata

_SPACE = " \\t\\n\\r\\x0b\\x0c"
#: Characters below this one don't change under normal forms.
_PLAIN_END = 0x250
#: White space other than ASCII, which this module and the library might see differently.
_UNSURE = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]")
#: A run of other characters with the single space before it, or a run of white space.
_SPACED = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Other white space; a text with it isn't cut under the rule SPACED.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁠　﻿]")
#: Longer pieces are not worth their memory.
_LONGEST_KEPT = 64

#: For tokenizers that lower-case and drop white space.
WORDS = "words"
#: For byte-level tokenizers that keep white space: a word has the space before it.
SPACED = "spaced"


def _of_kind(kind: str) -> str:
    return "".join(chr(c) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


def _pattern(rule: str) -> re.Pattern:
    """The tokenizers' own cut (fixed values), with its classes of letters and digits written out."""
    letter, digit = _of_kind("L"), _of_kind("N")
    ends = "'s|'t|'re|'ve|'m|'ll|'d"
    if rule == WORDS:
        return re.compile(f"{ends}|[{letter}]+|[{digit}]|[^{_SPACE}{letter}{digit}]+")
    return re.compile(
        f"{ends}| ?[{letter}]+| ?[{digit}]+| ?[^{_SPACE}{letter}{digit}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def _byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write each byte as a printable letter; others than these move up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class CachedEncoder:
    """Little-endian unsigned 32-bit token ids of texts.

    ``cache_entries`` bounds the memory and changes no result: at most twice as many pieces are kept,
    and those not asked for lately go.
    """

    def __init__(self, path: str, rule: str, cache_entries: int = 300_000):
        if rule not in (WORDS, SPACED):
            raise ValueError(f"unknown rule {rule}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._model._resize_cache(0)  # a second cache only costs time
        self._rule = rule
        self._entries = cache_entries
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._letters = _byte_letters()
        self._cut = _pattern(rule)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _missing(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            shown = piece.encode("utf-8").decode("latin-1").translate(self._letters)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(shown)])
        if len(piece) <= _LONGEST_KEPT:
            if len(self._new) >= self._entries:
                self._old, self._new = self._new, {}
            self._new[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = self._cut.findall(text.lower() if self._rule == WORDS else text)
        found = list(map(self._new.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._missing(pieces[i])
        return b"".join(found)

    def _words(self, text: str) -> list[str]:
        if self._rule == WORDS:
            return [w.decode("utf-8") for w in text.encode("utf-8").split()]
        return [text] if _OTHER_SPACE.search(text) else _SPACED.findall(text)

    def _is_plain(self, text: str) -> bool:
        return not _UNSURE.search(text) and not any(s in text for s in self._special)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; a null text has none."""
        if not text:
            return b""
        if self._is_plain(text):
            return self._plain(text)
        return b"".join([self._plain(w) if self._is_plain(w) else self._whole(w) for w in self._words(text)])


_encoders: dict[tuple[str, str, int], CachedEncoder] = {}


def encoder(path: str, rule: str, cache_entries: int = 300_000) -> CachedEncoder:
    """The encoder of this process; Spark's workers keep it from task to task."""
    key = path, rule, cache_entries
    if key not in _encoders:
        _encoders[key] = CachedEncoder(path, rule, cache_entries)
    return _encoders[key]
