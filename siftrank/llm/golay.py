"""The binary Golay code of 23 bits: every word lies within 3 bits of exactly one of 4,096 codewords."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 and its place, fixed value
BITS = 23


def _remainder(word: int) -> int:
    for shift in range(BITS - 1, 10, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of every 23-bit word's single bits, and the error pattern of every syndrome."""
    unit = np.array([_remainder(1 << b) for b in range(BITS)], np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    for size in range(4):
        for bits in combinations(range(BITS), size):
            syndrome = 0
            for b in bits:
                syndrome ^= int(unit[b])
            errors[syndrome] = sum(1 << b for b in bits)
    return unit, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Number (the high 12 bits) of the codeword within 3 bits of each 23-bit word."""
    unit, errors = _tables()
    syndrome = np.zeros(len(words), np.uint32)
    for b in range(BITS):
        syndrome ^= np.where(words >> np.uint32(b) & np.uint32(1), unit[b], np.uint32(0))
    return (words ^ errors[syndrome]) >> np.uint32(11)


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """Codeword numbers of each word and of the 23 words one bit away, as columns.

    A word has one or six different ones. Two words that differ in at most two bits have a
    word within one bit of both, so they share a number.
    """
    columns = [codeword_index(words)]
    columns += [codeword_index(words ^ np.uint32(1 << b)) for b in range(BITS)]
    return np.stack(columns, axis=1)
