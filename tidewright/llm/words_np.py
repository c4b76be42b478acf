"""Words and word hashes of UTF-8 text in numpy, for the operators that run in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX1, _MIX2, _MULT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes by word; holds so many words and then starts anew, so its memory is bounded."""

    limit = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def split_words(text: str | None) -> list[bytes]:
    """Words between blanks and tab to carriage return; bytes.split() has just these separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes_of(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _MULT + h[j : j + n]
    return mixed(out)


def whole(h: np.ndarray) -> np.uint64:
    """Hash of a sequence of words of any length."""
    out = np.uint64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = out * _MULT + x
    return mixed(np.array([out], dtype=np.uint64))[0]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of so many values, in about log2(width) passes."""
    n = len(v) - width + 1
    if n <= 0:
        return np.empty(0, dtype=v.dtype)
    span, out = 1, v
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])
