"""A wavelet matrix: the bit-planes of a token sequence with rank directories.

Plane 0 holds the highest bit of every token in order; each further plane holds the next bit after the tokens were stably
parted by the one before, zeros first. With a count of ones every ``SPAN`` bits, a plane answers how many ones lie before a position (rank)
and where the k-th zero or one is (select), so that tokens can be read, counted and looked up without unpacking the sequence.
"""

from __future__ import annotations

import numpy as np

SPAN = 512


class WaveletMatrix:
    def __init__(self, n: int, planes: np.ndarray, ranks: np.ndarray):
        """``planes``: bytes, one row per bit; ``ranks``: ones before each span, one row per bit."""
        self.n, self.planes, self.ranks = n, planes, ranks
        self.depth = len(planes)
        self.zeros = [n - self._ones_before(level, n) for level in range(self.depth)]

    @classmethod
    def build(cls, tokens: np.ndarray, depth: int) -> WaveletMatrix:
        order = np.asarray(tokens).astype(np.uint16 if depth <= 16 else np.uint32)
        n = len(order)
        width = -(-n // SPAN) * SPAN // 8
        planes, ranks = np.zeros((depth, width), np.uint8), np.zeros((depth, width * 8 // SPAN + 1), np.int32)
        for level in range(depth):
            bits = (order & order.dtype.type(1 << (depth - 1 - level))) != 0
            packed = np.packbits(bits)
            planes[level, : len(packed)] = packed
            if n:
                ranks[level, 1:] = np.cumsum(np.bitwise_count(planes[level]).reshape(-1, SPAN // 8).sum(axis=1))
            order = np.concatenate((order.take(np.flatnonzero(~bits)), order.take(np.flatnonzero(bits))))
        return cls(n, planes, ranks)

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.planes.tobytes(), self.ranks.astype("<i4").tobytes()

    @classmethod
    def from_bytes(cls, n: int, depth: int, planes: bytes, ranks: bytes) -> WaveletMatrix:
        return cls(n, np.frombuffer(planes, np.uint8).reshape(depth, -1), np.frombuffer(ranks, "<i4").reshape(depth, -1))

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).astype(bool)

    def _ones_before(self, level: int, at: int) -> int:
        span = at // SPAN
        rest = self.planes[level, span * SPAN // 8 : at // 8]
        ones = int(self.ranks[level, span]) + int(np.bitwise_count(rest).sum())
        return ones + (int(self.planes[level, at // 8]) >> (8 - at % 8)).bit_count() if at % 8 else ones

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) ``bit`` of a plane."""
        ones = self.ranks[level].astype(np.int64)
        counts = ones if bit else np.minimum(np.arange(len(ones)) * SPAN, self.n) - ones
        span = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.planes[level, span * SPAN // 8 : (span + 1) * SPAN // 8])
        return span * SPAN + int(np.flatnonzero(bits == bit)[k - int(counts[span])])

    def access(self, at: int) -> int:
        """The token at a position."""
        token = 0
        for level in range(self.depth):
            bit = int(self.planes[level, at // 8]) >> (7 - at % 8) & 1
            ones = self._ones_before(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where the tokens equal to ``token`` before position ``stop`` lie after the last plane."""
        low, high = 0, stop
        for level in range(self.depth):
            a, b = self._ones_before(level, low), self._ones_before(level, high)
            if token >> (self.depth - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, stop: int | None = None) -> int:
        """How often a token occurs before position ``stop`` (default: the end)."""
        if token >> self.depth:
            return 0
        low, high = self._range(token, self.n if stop is None else stop)
        return high - low

    def occurrence(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of a token."""
        at = self._range(token, self.n)[0] + k
        for level in reversed(range(self.depth)):
            bit = token >> (self.depth - 1 - level) & 1
            at = self._nth(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        order = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for level in reversed(range(self.depth)):
            bits = self._bits(level)
            before = np.empty_like(order)
            before[np.flatnonzero(~bits)] = order[: self.zeros[level]]
            before[np.flatnonzero(bits)] = order[self.zeros[level] :] | order.dtype.type(1 << (self.depth - 1 - level))
            order = before
        return order.astype(np.uint32)
