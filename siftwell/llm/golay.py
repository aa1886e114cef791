"""The binary Golay code of length 23: which codewords lie within distance 4 of a 23-bit vector.

Each vector has exactly one codeword within distance 3, and those at distance 3 have five more at distance 4. Two vectors that differ in
at most two bits have a vector at distance one from both, whose codeword is within distance 4 of either: they share a codeword.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, CHECKS = 23, 11
MOST_KEYS = 6


def _syndrome(vector: np.ndarray) -> np.ndarray:
    """Remainder of a 23-bit polynomial divided by the generator."""
    rest = vector.astype(np.int64)
    for shift in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> shift & 1, rest ^ (GENERATOR << (shift - CHECKS)), rest)
    return rest


@cache
def _offsets() -> np.ndarray:
    """For each of the 2,048 syndromes the error patterns of weight 4 or less with it, as a padded row (-1)."""
    patterns = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(LENGTH), w)], np.int64)
    out = np.full((1 << CHECKS, MOST_KEYS), -1, np.int64)
    used = np.zeros(1 << CHECKS, np.int64)
    for s, p in zip(_syndrome(patterns).tolist(), patterns.tolist(), strict=True):
        out[s, used[s]] = p
        used[s] += 1
    return out


def codeword_keys(segment: np.ndarray) -> np.ndarray:
    """(n, 6) 12-bit codeword indices of the codewords within distance 4 of each 23-bit segment; -1 pads."""
    segment = segment.astype(np.int64)
    errors = _offsets()[_syndrome(segment)]
    return np.where(errors >= 0, (segment[:, None] ^ errors) >> CHECKS, -1)
