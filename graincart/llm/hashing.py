"""Word and shingle hashes in numpy, for operators that work inside Python tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced_words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and the control characters 9 to 13, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` word hashes; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * _ODD
        out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def shingle_set(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(k, len(words))))
