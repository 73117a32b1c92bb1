"""The binary Golay code of 23 bits and its use as fuzzy hash keys.

The code is perfect: each 23-bit word lies within 3 bits of exactly one of the 4096
codewords. A word within 2 bits of its codeword shares it with all words one bit
away; a word 3 bits off has five further codewords at 4 bits. So with
``nearest(x)`` as x's one index key and ``around(y)`` as y's probe keys, any x and y that
differ in at most one bit meet: nearest(x) is in around(y).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator, 11 bits, from the remainders of the single bits."""
    out = np.zeros(words.shape, dtype=np.int64)
    for bit in range(23):
        r = 1 << bit
        for at in range(22, 10, -1):
            if r >> at & 1:
                r ^= GENERATOR << (at - 11)
        out ^= np.where(words >> bit & 1, r, 0)
    return out


@lru_cache(maxsize=1)
def corrections() -> np.ndarray:
    """The error pattern of up to 3 bits for each of the 2048 syndromes."""
    patterns = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)], dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[syndrome(patterns)] = patterns
    return table


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within 3 bits of each word."""
    return (words ^ corrections()[syndrome(words)]) >> 11


def around(words: np.ndarray) -> np.ndarray:
    """All codeword indices within 4 bits, shape (n, 24): the nearest and those of the words one bit away; repeats stay."""
    near = [nearest(words)] + [nearest(words ^ (1 << bit)) for bit in range(23)]
    return np.stack(near, axis=1)


def around_distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``around`` without repeats: (row of the word, codeword index)."""
    keys = np.sort(around(words), axis=1)
    fresh = np.ones(keys.shape, dtype=bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    rows, cols = np.nonzero(fresh)
    return rows, keys[rows, cols]
