"""The binary Golay code [23, 12, 7] and the keys by which near 23-bit words find each other.

The code is perfect: each word lies within three errors of one codeword. A word gets the index of that codeword and,
if it is three errors away, those of the five codewords at distance four. Two words that differ in two bits at most then share
an index (tests check all cases), and only those indices need to meet.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _parity(message: int) -> int:
    rest = message << 11
    for bit in range(22, 10, -1):
        if rest >> bit & 1:
            rest ^= GENERATOR << (bit - 11)
    return rest


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """parity: of each 12-bit message; near: for each syndrome, up to six error patterns (rest -1), the least one first."""
    parity = np.array([_parity(m) for m in range(1 << 12)], np.int64)
    syndrome = lambda e: (e & 2047) ^ int(parity[e >> 11])
    near = np.full((2048, 6), -1, np.int64)
    for weight in range(4):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            near[syndrome(e), 0] = e
    heavy = [c for m in range(1 << 12) if (c := m << 11 | int(parity[m])).bit_count() == 7]
    for s in range(2048):
        e = int(near[s, 0])
        if e.bit_count() == 3:
            near[s, 1:] = [e ^ c for c in heavy if c & e == e]
    return parity, near


def indices(words: np.ndarray) -> np.ndarray:
    """(n, 6): the codeword indices of each 23-bit word, -1 where there are fewer."""
    parity, near = tables()
    words = words.astype(np.int64)
    errors = near[(words & 2047) ^ parity[words >> 11]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)
