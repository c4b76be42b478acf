"""Hashed counts against plain sums over digests."""

import hashlib

import numpy as np
import pytest

from tidewright.functions.features import Hashed, counts, identifiers, slots


@pytest.mark.parametrize("dim", [256, 512, 100])
def test_counts_are_sums_over_digests(dim):
    words = identifiers("someThing in_the way she moves, in the way 3dModels move")
    want = np.zeros(dim, int)
    for f in words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)]:
        digest = hashlib.sha256(f.encode()).digest()
        want[int.from_bytes(digest[:9], "big") % dim] += 1 if digest[1] & 128 else -1
    assert "some" in words and (counts(words, Hashed(dim)) == want).all()
    at, sign = slots(words, Hashed(dim))
    assert (np.bincount(at, sign, minlength=dim) == want).all()


def test_pairs_take_no_memory():
    """Most pairs stand once in a corpus: they aren't held."""
    hashed = Hashed()
    words = [f"w{i % 30}" for i in range(1_000)] + [f"w{i * i % 29}" for i in range(1_000)]
    assert counts(words, hashed).any() and len(hashed) == 30
    assert not counts([], hashed).any() and counts(["xx"], hashed).any()
