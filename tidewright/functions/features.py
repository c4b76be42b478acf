"""Words of a text and their hashed counts, for functions that run in Python workers."""

from __future__ import annotations

import hashlib
import re

import numpy as np

DIM = 256
_HUMP, _TOKEN = re.compile("([a-z0-9])([A-Z])"), re.compile("[a-z0-9_]+")


def identifiers(text: str | None) -> list[str]:
    """Lower-case tokens of two characters at least, camelCase and snake_case taken apart."""
    return [t for t in _TOKEN.findall(_HUMP.sub(r"\1 \2", text or "").lower().replace("_", " ")) if len(t) >= 2]


class Hashed(dict):
    """Slot and sign of a word by its SHA-256, as one number (twice the slot, and one more if it counts down); each is hashed once as long as it is held."""

    limit = 1_000_000

    def __init__(self, dim: int = DIM):
        super().__init__()
        self.dim = dim

    def __missing__(self, feature: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        digest = hashlib.sha256(feature.encode()).digest()[:9]
        self[feature] = found = 2 * (int.from_bytes(digest, "big") % self.dim) + (not digest[1] & 128)
        return found


def _coded(words: list[str], hashed: Hashed) -> np.ndarray:
    """Numbers of the words and then of their pairs. Words come again and are held; most pairs don't, so they are hashed where they stand."""
    own = np.fromiter(map(hashed.__getitem__, words), np.int32, len(words))
    if len(words) < 2:
        return own
    told, sha = [w.encode() for w in words], hashlib.sha256
    digests = np.frombuffer(b"".join([sha(b"%b_%b" % p).digest() for p in zip(told, told[1:], strict=False)]), np.uint8).reshape(-1, 32)
    rest = np.zeros(len(digests), np.int64)
    for byte in (8,) if 256 % hashed.dim == 0 else range(9):
        rest = (rest * 256 + digests[:, byte]) % hashed.dim
    return np.concatenate([own, (2 * rest + (digests[:, 1] < 128)).astype(np.int32)])


def slots(words: list[str], hashed: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of the words and their pairs, one after another."""
    coded = _coded(words, hashed)
    return coded >> 1, 1 - 2 * (coded & 1)


def counts(words: list[str], hashed: Hashed) -> np.ndarray:
    """Signed counts of the words and their pairs."""
    both = np.bincount(_coded(words, hashed), minlength=2 * hashed.dim)
    return (both[::2] - both[1::2]).astype(np.int32)
