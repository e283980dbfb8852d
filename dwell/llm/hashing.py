"""64-bit codes of numpy arrays, used to name n-grams by bucket: the high bits are the well mixed ones."""

from __future__ import annotations

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def ngrams(codes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """One 64-bit code for each window of ``n`` codes (4 at most), order included."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(codes) - n + 1, (salt + n) * _ODD[3] % 2**64, np.uint64)
        for k in range(n):
            out += codes[k : len(codes) - n + 1 + k] * np.uint64(_ODD[k])
        return (out ^ (out >> np.uint64(29))) * np.uint64(_ODD[1])
