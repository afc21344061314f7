"""Word shingles as 64-bit hashes, for Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words per shingle, unless a caller says otherwise.
WIDTH = 5
#: Distinct words a task remembers before it starts afresh.
REMEMBERED = 500_000
_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15


def salt(i: int) -> np.uint64:
    """The ``i``-th of a sequence of well spread odd numbers."""
    return _U((_GOLDEN * i) & 0xFFFF_FFFF_FFFF_FFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the SplitMix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Scrambled integers as floats in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; only ASCII white space separates."""
    return text.lower().split() if text else []


def shingle_hashes(tokens: list[bytes], known: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Hash of every shingle in order; the whole sequence is one if it is shorter than a shingle; none without words."""
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, n)
    w = min(width, n)
    out = np.full(n - w + 1, _U(w), np.uint64)
    for i in range(w):
        out += mix(h[i : n - w + 1 + i] + salt(i + 1))
    return mix(out)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted without repetition."""
    if len(hashes) < 2:
        return hashes
    s = np.sort(hashes)
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
