"""Words of whole texts and their hashes, for the operators of this folder."""

from __future__ import annotations

import numpy as np
import xxhash

#: Lower-cases A-Z only; bytes of other letters stay as they are.
LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(data: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split`` knows exactly these separators."""
    return data.split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` words; none if there are fewer words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total *= _MULTIPLIER
        total += hashes[k : k + n]
    return mix(total)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles of a whole text.

    A text with fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    if not text:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words(text.encode("utf-8", "replace").translate(LOWER_ASCII)))
    if 0 < len(hashes) < size:
        return window_hashes(hashes, len(hashes))
    return np.unique(window_hashes(hashes, size))
