"""Vectorised rolling hashes, word splitting and winnowed anchors over sequences of units.

A unit is a byte or a word. Hashes are polynomials modulo 2^64 over random unit values; equal
content always gives equal hashes. Such polynomials collide on some strings of many hundred units (Thue-Morse
strings), whatever the random values: windows and blocks are far shorter, and words and lines of
``LONG_BYTES`` or more are hashed by BLAKE2 instead. Winnowing takes the rightmost smallest k-gram hash of each
window of n units, so equal windows choose the same anchor. The windows that choose one anchor
are neighbours; together they form its block.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240607))
#: Random value of each byte.
BYTE_VALUES = _SEED.integers(0, 1 << 64, 256, dtype=np.uint64)
#: Odd multipliers of the lanes; two lanes make a 128-bit hash.
BASES = tuple(int(x) | 1 for x in _SEED.integers(0, 1 << 64, 2, dtype=np.uint64))
#: From this length on words and lines are hashed by BLAKE2.
LONG_BYTES = 128
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(lane: int, inverse: bool, size: int) -> np.ndarray:
    base = pow(BASES[lane], -1, 1 << 64) if inverse else BASES[lane]
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(lane: int, inverse: bool, count: int) -> np.ndarray:
    return _powers(lane, inverse, 1 << max(16, int(count).bit_length()))[:count]


class Rolling:
    """Hashes of any stretches of one sequence of unit values, in constant time each."""

    def __init__(self, values: np.ndarray, lane: int = 0):
        self.lane, self.size = lane, len(values)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(values * powers(lane, False, self.size), out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Hash of each stretch of one length, by start."""
        count = self.size - length + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mix(
            (self.sums[length:] - self.sums[:count]) * powers(self.lane, True, self.size)[:count]
        )

    def some(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the stretches [start, end); the length is part of it."""
        value = (self.sums[ends] - self.sums[starts]) * powers(self.lane, True, self.size + 1)[
            starts
        ]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows; rows never share a word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    black = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = black.copy()
    starts[1:] &= ~black[:-1] | edge[1:-1]
    ends = black.copy()
    ends[:-1] &= ~black[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def byte_strings(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0
) -> np.ndarray:
    """A 64-bit value of each stretch of bytes, whatever its length."""
    values = Rolling(BYTE_VALUES[raw], lane).some(starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG_BYTES):
        digest = blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=b"lane%d" % lane)
        values[i] = int.from_bytes(digest.digest(), "little")
    return values


def word_values(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0
) -> np.ndarray:
    """A 64-bit value of each word; those of two lanes are independent."""
    return byte_strings(raw, starts, ends, lane)


class Blocks(NamedTuple):
    """Winnowed anchors of a sequence of units that holds several rows, one per block."""

    row: np.ndarray
    anchor: np.ndarray  # position of the anchor
    first: np.ndarray  # first window start that chooses it
    last: np.ndarray  # last window start that chooses it
    key: np.ndarray  # hash of the anchor's k units
    content: np.ndarray  # hash of all units from the first window's start to the last one's end


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def blocks(rolling: Rolling, offsets: np.ndarray, window: int, k: int) -> Blocks:
    """Anchors and blocks of all rows. ``offsets``: n + 1 unit offsets of the rows."""
    lengths = np.diff(offsets)
    count = rolling.size - window + 1
    none = np.zeros(0, np.int64)
    if count <= 0 or not (lengths >= window).any():
        return Blocks(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    grams = rolling.all(k)
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place)
    best = sliding_min(packed, window - k + 1)
    chosen = (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)[:count]
    valid = np.arange(count) + window <= offsets[1:][row]
    change = np.ones(count, bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.ones(count, bool)
    stop[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    anchor = chosen[first]
    return Blocks(
        row[first], anchor, first, last, grams[anchor], rolling.some(first, last + window)
    )


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true stretches."""
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` units lie in any of the stretches."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0
