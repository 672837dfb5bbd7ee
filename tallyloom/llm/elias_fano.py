"""Elias-Fano codes of ascending integers, with select and a running decoder."""

from __future__ import annotations

import struct

import numpy as np

#: A relative position for every so many values, and a full one for every so many of those.
SAMPLE, GROUP = 256, 16
#: Values that the coder takes at a time; a multiple of 8, so that packed low bits end at a byte.
_CHUNK = 1 << 16
_HEAD = struct.Struct("<QqQB")
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)


class EliasFano:
    """n ascending integers below base + u in about n * (2 + log2(u / n)) bits.

    The low bits of each value are packed; the high bits stand in unary in a
    bit vector, where the i-th set bit (select) gives the i-th value. The place of
    every 256th set bit is stored as a 32-bit number relative to its group of 16
    such samples, whose first place is a 64-bit number: 1.1 bits a value for 1024.
    A select reads these two and scans the bits up to the value; ``slice`` decodes
    a run of values from its sample on. Nothing is made for all values when a code is
    loaded: what it holds are views of the bytes given.
    """

    def __init__(self, n: int, base: int, width: int, low: np.ndarray, high: np.ndarray, starts: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.width, self.low, self.high = n, base, width, low, high
        self.starts, self.samples = starts, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """The code of ascending values; beside them it takes memory for a chunk at a time."""
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        base = int(v[0]) if n else 0
        span = int(v[-1]) - base if n else 0
        width = max(0, (span // n).bit_length() - 1) if n else 0
        high = np.zeros((n + (span >> width)) // 8 + 1 if n else 0, np.uint8)
        lows: list[np.ndarray] = []
        places: list[np.ndarray] = []
        for first in range(0, n, _CHUNK):
            rest = v[first : first + _CHUNK].astype(np.uint64) - np.uint64(base & ((1 << 64) - 1))
            if width:
                bits = (rest[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
                lows.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
            where = (rest >> np.uint64(width)).astype(np.int64) + np.arange(first, first + len(rest))
            np.bitwise_or.at(high, where >> 3, (1 << (where & 7)).astype(np.uint8))
            places.append(where[::SAMPLE])
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        starts = at[::GROUP]
        samples = (at - np.repeat(starts, GROUP)[: len(at)]).astype("<u4")
        return cls(n, base, width, np.concatenate(lows) if lows else np.zeros(0, np.uint8), high, starts.astype("<u8"), samples)

    def _place(self, sample: int) -> int:
        return int(self.starts[sample // GROUP]) + int(self.samples[sample])

    def _low(self, i: int, j: int) -> np.ndarray:
        first = i * self.width
        raw = np.unpackbits(self.low[first >> 3 : (j * self.width + 7) >> 3], bitorder="little")[first & 7 :]
        bits = raw[: (j - i) * self.width].reshape(j - i, self.width).astype(np.uint64)
        return (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i to j (exclusive) as int64: the bits from i's sample to that after j are read."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        sample = i // SAMPLE
        begin = self._place(sample)
        after = (j - 1) // SAMPLE + 1
        end = self._place(after) if after < len(self.samples) else len(self.high) * 8
        bits = _BIT[self.high[begin >> 3 : (end + 7) >> 3]].ravel()
        bits[: begin & 7] = False
        skip = i - sample * SAMPLE
        place = (np.flatnonzero(bits)[skip : skip + j - i] + (begin & ~7) - np.arange(i, j)).astype(np.uint64)
        high = place << np.uint64(self.width)
        if self.width:
            high |= self._low(i, j)
        return (high + np.uint64(self.base & ((1 << 64) - 1))).astype(np.int64)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = self._place(i // SAMPLE)
        left = i % SAMPLE
        byte, bits = place >> 3, int(self.high[place >> 3]) >> (place & 7) << (place & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        low = int(self._low(i, i + 1)[0]) if self.width else 0
        return self.base + ((place - i) << self.width | low)

    def to_bytes(self) -> bytes:
        parts = (self.low, self.high, self.starts, self.samples)
        return _HEAD.pack(self.n, self.base, len(self.high), self.width) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[EliasFano, int]:
        """The code, as views of ``data``, and how many bytes it took."""
        n, base, n_high, width = _HEAD.unpack_from(data)
        n_samples = -(-n // SAMPLE)
        at, parts = _HEAD.size, []
        for dtype, size in (("u1", (n * width + 7) // 8), ("u1", n_high), ("<u8", -(-n_samples // GROUP)), ("<u4", n_samples)):
            parts.append(np.frombuffer(data, dtype, size, at))
            at += parts[-1].nbytes
        return cls(n, base, width, *parts), at
