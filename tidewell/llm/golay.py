"""Keys of 64-bit fingerprints, such that any two that differ in at most three bits share one.

The binary Golay code is perfect: each word of 23 bits is at most three bits from exactly one
of 4096 codewords. A word one or two bits from its codeword has that codeword as its only key; one
three bits away has five more, the codewords four bits away. Any two words that differ in at
most two bits share a key then.

A fingerprint is six blocks, two triangles of three. A key is two blocks of a triangle as they
are and the codeword of two other blocks. For three errors anywhere one of the six choices in
``PAIRS`` has none in the first two blocks and at most two in the others: if a triangle has exactly
two blocks without errors, the other triangle has at most two errors; if it has three, the three
pairs of the other triangle hold its errors twice over, so one of them holds at most two; else
two or three blocks of one triangle have errors, and the other triangle is such a one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Bits of the blocks, from the lowest; two triangles.
BLOCKS = (11, 11, 10, 11, 11, 10)
#: (blocks that are equal, blocks whose codewords are near).
PAIRS = (((0, 1), (3, 4)), ((1, 2), (4, 5)), ((0, 2), (3, 5)), ((3, 4), (0, 1)), ((4, 5), (1, 2)), ((3, 5), (0, 2)))
DISTANCE = 3


def _remainder(word: int) -> int:
    """The remainder of a word's polynomial by the generator: 11 bits, 0 for a codeword."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(remainders of each byte's values at three places, error of each remainder, keys' differences, number of keys)."""
    by_byte = np.array([[_remainder(v << s & 0x7FFFFF) for v in range(256)] for s in (0, 8, 16)], np.int32)
    words = np.arange(4096, dtype=np.int64)
    code = words << 11
    code |= by_byte[0][code & 255] ^ by_byte[1][code >> 8 & 255] ^ by_byte[2][code >> 16]
    light = code[np.bitwise_count(code) == 7]
    error, extra, n = np.zeros(2048, np.int64), np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            at = _remainder(e)
            error[at] = e
            if weight == 3:
                extra[at, 1:] = light[(light & e) == e] >> 11
                n[at] = 6
    return by_byte, error, extra, n


_BY_BYTE, _ERROR, _EXTRA, _N = _tables()


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of keys of each word): numbers of codewords from 0 to 4095, a word's keys in a row."""
    words = words.astype(np.int64)
    rest = _BY_BYTE[0][words & 255] ^ _BY_BYTE[1][words >> 8 & 255] ^ _BY_BYTE[2][words >> 16 & 127]
    n = _N[rest]
    keys = ((words ^ _ERROR[rest]) >> 11)[:, None] ^ _EXTRA[rest]
    return keys[np.arange(6) < n[:, None]], n


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of each key's fingerprint); unsigned fingerprints, about 32 keys each."""
    edges = np.cumsum((0, *BLOCKS))
    block = [(prints >> np.uint64(a)).astype(np.int64) & ((1 << w) - 1) for a, w in zip(edges, BLOCKS)]
    all_keys, owners = [], []
    for i, ((a, b), (c, d)) in enumerate(PAIRS):
        near, n = near_codewords(block[c] | block[d] << BLOCKS[c])
        owner = np.repeat(np.arange(len(prints)), n)
        equal = block[a] | block[b] << BLOCKS[a]
        all_keys.append((i << 22 | equal)[owner] << 12 | near)
        owners.append(owner)
    return np.concatenate(all_keys), np.concatenate(owners)
