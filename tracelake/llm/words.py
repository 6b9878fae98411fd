"""Words of whole texts as 64-bit hashes, vectorised over a batch of texts.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return, with A to Z
lower-cased. Its hash is a polynomial of random byte values modulo 2**64, taken from running sums, so that no word is
ever a Python object; equal words have equal hashes, and different ones differ but for a chance of 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240601)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 18
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
VALUES = BYTE_VALUES[LOWER]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) < n + 1:
        size = 1 << max(18, int(n + 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(x))]), dtype=np.uint64)
                      for x in (BASE, BASE_INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that aren't `blank`), and len + 1 offsets of each text into them."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """64-bit hashes of byte spans of `data`, in order; `BLOCK` bytes are worked on at a time."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        part, a, b = data[first: ends[j - 1]], starts[i:j] - first, ends[i:j] - first
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], dtype=np.uint64, out=sums[1:])
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and len + 1 offsets of each text into them."""
    starts, ends, first = spans(data, offsets)
    return hashes(data, starts, ends), first


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its distinct shingles of `size` words as sorted hashes; a shorter text is one shingle, a text
    without words has none."""
    word, first = word_hashes(data, offsets)
    n = max(0, len(word) - size + 1)
    joined = np.zeros(n, np.uint64)
    for i in range(size):
        joined = mix(joined * np.uint64(0x100000001B3) + word[i: i + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            found = np.sort(joined[a: b - size + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in word[a:b]:
                short = mix(short * np.uint64(0x100000001B3) ^ x)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Lookup:
    """Open-addressing table from 64-bit keys to their positions."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.zeros((1 << self.bits) + 64, np.uint64)
        self.at = np.full(len(self.keys), -1, np.int32)
        slot, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.at[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.at[slot[put]], self.keys[slot[put]] = put, keys[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] += 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.at[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] += 1
            out[open_] = self.at[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out
