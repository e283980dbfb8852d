"""Keys of 23-bit words from the perfect binary Golay code, such that near words share a key.

Each word lies within 3 bits of exactly one codeword. A word at distance 3 from it also takes the five codewords at
distance 4; so it has six keys, a word nearer to its codeword one. Two words that differ in one bit always share a
key: if both are within 3 of one codeword it is that one, and otherwise both lie at distance 3 from their own, at
distance 4 from the other's.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the code.
GENERATOR = 0b101011100011
N, K = 23, 12


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder by the generator: 0 for codewords, and one of 2^11 for the error patterns of up to 3 bits."""
    out = words.astype(np.int64, copy=True)
    for bit in range(N - 1, N - K - 1, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - (N - K)), 0)
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of up to 3 bits; and the five patterns of 4 bits, -1 where there are none."""
    near = np.zeros(1 << (N - K), np.int64)
    far = np.full((1 << (N - K), 5), -1, np.int64)
    for weight in range(4):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(N), weight)], np.int64)
        near[_syndrome(patterns)] = patterns
    four = np.array([sum(1 << b for b in bits) for bits in combinations(range(N), 4)], np.int64)
    syndrome = _syndrome(four)
    order = np.argsort(syndrome, kind="stable")
    s, four = syndrome[order], four[order]
    heavy = np.bitwise_count(near[s]) == 3
    s, four = s[heavy], four[heavy]
    rank = np.arange(len(s)) - np.searchsorted(s, s)
    far[s, rank] = four
    return near, far


def keys(words: np.ndarray) -> np.ndarray:
    """Six columns of 12-bit codeword indices, -1 where a word has no more."""
    near, far = tables()
    words = words.astype(np.int64)
    s = _syndrome(words)
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = (words ^ near[s]) >> (N - K)  # the code is systematic in its upper bits
    more = far[s]
    out[:, 1:] = np.where(more >= 0, (words[:, None] ^ more) >> (N - K), -1)
    return out
