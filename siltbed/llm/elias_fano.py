"""Elias-Fano coding of sorted integers in numpy: high bits in unary, low bits packed."""

from __future__ import annotations

import numpy as np


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` as consecutive little-endian fields of ``width`` bits, with 8 bytes of padding for wide reads."""
    if width == 0 or len(values) == 0:
        return np.zeros(8, np.uint8)
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])


class EliasFano:
    """A sorted multiset of integers below 2**bits (bits up to 56), kept in about 2 + log2(2**bits / n) bits each."""

    def __init__(self, n: int, low_bits: int, highs: bytes, lows: bytes):
        self.n, self.low_bits = n, low_bits
        self.highs, self.lows = np.frombuffer(highs, np.uint8), np.frombuffer(lows, np.uint8)
        ones = np.unpackbits(self.highs, bitorder="little")
        #: ends[h]: how many values have a high part of at most h.
        self.ends = np.flatnonzero(ones == 0).astype(np.int64) - np.arange(np.count_nonzero(ones == 0))

    @classmethod
    def encode(cls, values: np.ndarray, bits: int) -> "EliasFano":
        n = len(values)
        low_bits = max(0, bits - max(n, 1).bit_length())
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros(n + (1 << (bits - low_bits)) + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        lows = _pack(values & np.uint64((1 << low_bits) - 1), low_bits)
        return cls(n, low_bits, np.packbits(unary, bitorder="little").tobytes(), lows.tobytes())

    def nbytes(self) -> int:
        return len(self.highs) + len(self.lows)

    def _low(self, index: np.ndarray) -> np.ndarray:
        if self.low_bits == 0:
            return np.zeros(len(index), np.uint64)
        at = index * self.low_bits
        window = self.lows[(at >> 3)[:, None] + np.arange(8)].copy().view(np.uint64)[:, 0]
        return (window >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(np.arange(self.n))

    def successor(self, probes: np.ndarray) -> np.ndarray:
        """For each probe the index of the smallest value that is not below it (n if there is none)."""
        high = (probes >> np.uint64(self.low_bits)).astype(np.int64)
        low = probes & np.uint64((1 << self.low_bits) - 1)
        lo, hi = np.where(high > 0, self.ends[np.maximum(high - 1, 0)], 0), self.ends[high].copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) >> 1
            below = self._low(middle) < low[open_]
            lo[open_[below]] = middle[below] + 1
            hi[open_[~below]] = middle[~below]
        return lo

    def values_at(self, index: np.ndarray) -> np.ndarray:
        """The values at the given indices; the high part is found from the running counts."""
        high = np.searchsorted(self.ends, index, side="right")
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(index)
