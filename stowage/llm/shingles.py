"""Word shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of every hash (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = 4) -> np.ndarray:
    """The distinct hashes of all ``width``-word shingles, ascending.

    A-Z are lower-cased; fewer words than ``width`` make one shingle of them
    all; no words make none.
    """
    # On bytes, lower() knows A-Z alone and split() the six ASCII blanks alone.
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix((out + h[k : len(h) - n + 1 + k]) * _MIX)
    return np.unique(out)
