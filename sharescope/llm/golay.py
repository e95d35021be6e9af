"""The binary [23, 12, 7] Golay code: every word of 23 bits lies within distance 3 of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
GENERATOR = 0b101011100011


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word, as a polynomial, by the generator: 0 for codewords only."""
    rest = np.array(words, dtype=np.int64)
    for bit in range(LENGTH - 1, LENGTH - DATA, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return np.where(rest >> 11 & 1, rest ^ GENERATOR, rest)


def _errors() -> np.ndarray:
    """The one pattern of up to three errors behind each of the 2,048 syndromes."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(LENGTH), n)])
    table = np.zeros(1 << (LENGTH - DATA), dtype=np.int64)
    table[syndrome(patterns)] = patterns
    return table


_ERRORS = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word."""
    words = np.asarray(words, dtype=np.int64)
    return (words ^ _ERRORS[syndrome(words)]) >> (LENGTH - DATA)


def nearby(words: np.ndarray, bits: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices of all words at most one of `bits` bits away, word after word, and how many each word has."""
    around = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(decode(np.asarray(words, dtype=np.int64)[:, None] ^ around), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return found[new], new.sum(axis=1)
