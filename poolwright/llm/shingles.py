"""Word shingles of texts as 64-bit hashes, inside Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: A worker forgets its word hashes when it has so many.
CACHE = 100_000
#: Odd 64-bit multipliers.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    """Words of the text after lower-casing A-Z: runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes. Fewer words than a shingle: the whole sequence as one; no words: empty."""
    found = split_words(text)
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, n)
    odd = np.resize(_ODD, words) * (np.arange(words, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    if n < words:
        return mix(np.array([(h * odd[:n]).sum() + np.uint64(n)], np.uint64))
    total = h[: n - words + 1] * odd[0]
    for k in range(1, words):
        total += h[k : n - words + 1 + k] * odd[k]
    return np.unique(mix(total))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union. Empty sets are similar to nothing."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
