"""Bloom filters in segments, as numpy arrays inside tasks.

A 64-bit code's first bits name its segment, the next 32 bits its places in
it, so the segments of one filter can be built by different tasks and each is
of fixed size.
"""

from __future__ import annotations

import numpy as np

#: Bits of a segment (a power of two), places per code, bits per code of a filter with its full size.
SEGMENT_BITS = 1 << 22
PLACES = 4
BITS_PER_CODE = 12
SEGMENT_BYTES = SEGMENT_BITS // 8


def segments_for(codes: int, most: int | None = None) -> int:
    """How many of a code's first bits name the segment: 2 ** of it segments give ``codes`` codes their bits each."""
    power = max(0, int(np.ceil(np.log2(max(1, codes) * BITS_PER_CODE / SEGMENT_BITS))))
    return power if most is None else min(power, most)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_of(codes: np.ndarray, power: int) -> np.ndarray:
    return (codes >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(codes), np.int64)


def places(codes: np.ndarray, power: int) -> list[np.ndarray]:
    """The places of codes inside their segment."""
    h = mix(((codes << np.uint64(power)) >> np.uint64(32)) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for i in range(PLACES)]


def segment_filter(codes: np.ndarray, power: int) -> np.ndarray:
    """One segment's filter of its codes, as bytes."""
    bits = np.zeros(SEGMENT_BITS, bool)
    for p in places(codes, power):
        bits[p] = True
    return np.packbits(bits, bitorder="little")


class TwoFilters:
    """The once-seen and the twice-seen filter of one segment."""

    def __init__(self, power: int):
        self.power = power
        self.once = np.zeros(SEGMENT_BITS, bool)
        self.twice = np.zeros(SEGMENT_BITS, bool)

    def add(self, codes: np.ndarray, repeated: np.ndarray) -> None:
        """Add the distinct codes of one batch; ``repeated`` tells those the batch itself holds more than once."""
        at = places(codes, self.power)
        seen = repeated.astype(bool)
        before = np.ones(len(codes), bool)
        for p in at:
            before &= self.once[p]
        seen |= before
        for p in at:
            self.once[p] = True
            self.twice[p[seen]] = True

    def seen_twice(self, codes: np.ndarray) -> np.ndarray:
        hit = np.ones(len(codes), bool)
        for p in places(codes, self.power):
            hit &= self.twice[p]
        return hit


def contains(filters: np.ndarray, power: int, codes: np.ndarray) -> np.ndarray:
    """Which codes a filter of 2 ** power segments (one byte array, segment after segment) holds."""
    base = segment_of(codes, power) * SEGMENT_BITS
    hit = np.ones(len(codes), bool)
    for p in places(codes, power):
        p = p + base
        hit &= (filters[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return hit
