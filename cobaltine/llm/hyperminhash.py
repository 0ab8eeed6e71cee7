"""HyperMinHash: MinHash whose registers keep a leading-zero count and a few mantissa bits.

Each register takes the minimum of all shingles under a hash of its own.  Dealing the shingles
out over the registers by one hash would be cheaper, but sets of a few shingles then leave
most registers empty; what these borrow from others depends on one another, and links of small
sets get lost.  As it is, two sets agree in each register with the probability of their
similarity, independently of the other registers and however small they are.
"""

from __future__ import annotations

import math

import numpy as np

from .arrays import mix

MANTISSA_BITS = 10
REGISTERS = 256
VALUE_BITS = 56
#: registers of a band; a link at similarity 0.8 shares none of the bands with probability 2e-9, one at 0.85 with 1e-13
ROWS, BANDS = 5, 51
#: chance that a link's estimate falls below what ``least_agreeing`` asks
CUT_LOSS = 1e-8
#: of each register, what its hash adds to and multiplies a shingle's hash with
SEEDS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, REGISTERS)
#: shingle hashes that are worked on at once
AT_ONCE = 1 << 15


def bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> np.uint64(32)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 [rows, REGISTERS] of sets of 64-bit hashes.  An empty set has zeros only."""
    sizes = np.array(list(map(len, sets)), np.int64)
    least = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    filled = np.flatnonzero(sizes)
    h, starts = np.concatenate([*sets, np.zeros(0, np.uint64)]), (np.cumsum(sizes) - sizes)[filled]
    for at in range(0, len(h), AT_ONCE):
        part = h[at : at + AT_ONCE]
        # the rows that have shingles in this part, and where these start in it
        rows = slice(int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, at + len(part))))
        own, begin = filled[rows], np.maximum(starts[rows] - at, 0)
        for i, (add, factor) in enumerate(zip(SEEDS[0], SEEDS[1] | np.uint64(1), strict=True)):
            x = part + add
            x *= factor
            least[own, i] = np.minimum(least[own, i], np.minimum.reduceat(x, begin))
    least >>= np.uint64(64 - VALUE_BITS)
    length = bit_length(least).astype(np.uint64)
    shift = length.astype(np.int64) - 1 - MANTISSA_BITS
    mantissa = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    zeros = (np.uint64(VALUE_BITS) - np.minimum(length, np.uint64(VALUE_BITS))) << np.uint64(MANTISSA_BITS)
    out = (zeros | mantissa).astype(np.uint16)
    out[sizes == 0] = 0
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """uint64 [rows, BANDS]: a hash of each band's number and registers."""
    parts = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += parts[:, :, i]
        out ^= out >> np.uint64(29)
    return mix(out)


#: chance that registers of different values are equal all the same: the same number of zeros (1/3) and the same mantissa
COLLISION = 1 / 3 / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets behind two rows of registers, less what chance collisions add."""
    return np.maximum(0.0, ((a == b).mean(axis=1) - COLLISION) / (1 - COLLISION))


def least_estimate(similarity: float, loss: float = CUT_LOSS) -> float:
    """The largest estimate below which sets of this similarity fall with a chance of ``loss`` at most, by the binomial tail of their equal registers."""
    tail, equal = 0.0, 0
    while (tail := tail + math.comb(REGISTERS, equal) * similarity**equal * (1 - similarity) ** (REGISTERS - equal)) <= loss:
        equal += 1
    return (equal / REGISTERS - COLLISION) / (1 - COLLISION) - 1e-9
