"""Wavelet matrix of a token sequence: bit-planes with rank directories (Claude, Navarro and Ordonez, 2015).

Plane k holds bit k of every token, from the highest bit; below a plane the tokens are dealt stably
into those with a 0 bit and those with a 1 bit.  Access, counting and occurrence lookup follow one
position through the planes with rank and select.
"""

from __future__ import annotations

import numpy as np

#: Bits between the entries of a rank directory.
STEP = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def build(tokens: np.ndarray, bits: int) -> tuple[bytes, bytes, list[int]]:
    """(planes, rank directories, zeros of each plane) of ``tokens``."""
    now, planes, ranks, zeros = tokens, [], [], []
    for k in range(bits - 1, -1, -1):
        bit = (now >> k) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        planes.append(packed.tobytes())
        padded = np.zeros(-(-len(packed) * 8 // STEP) * (STEP // 8), np.uint8)
        padded[: len(packed)] = packed
        counts = _ONES[padded.reshape(-1, STEP // 8)].sum(axis=1) if len(packed) else np.zeros(0, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
        now = np.concatenate([now[~bit], now[bit]])
        zeros.append(int(len(bit) - bit.sum()))
    return b"".join(planes), b"".join(ranks), zeros


class WaveletMatrix:
    """Queries over a matrix that :func:`build` made."""

    def __init__(self, n: int, bits: int, planes: bytes, ranks: bytes, zeros: list[int]):
        self.n, self.bits, self.zeros = n, bits, zeros
        width = (n + 7) // 8
        self.planes = np.frombuffer(planes, np.uint8).reshape(bits, width) if n else np.zeros((bits, 0), np.uint8)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(bits, -1)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k, i >> 3]) >> (i & 7) & 1

    def _rank1(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block = i // STEP
        own = self.planes[k, block * (STEP // 8) : (i + 7) >> 3]
        ones = int(_ONES[own].sum())
        if i & 7 and len(own):
            ones -= int(_ONES[int(own[-1]) >> (i & 7)])
        return int(self.ranks[k, block]) + ones

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) ``bit`` of plane k."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            seen = self._rank1(k, mid + 1)
            if (seen if bit else mid + 1 - seen) > j:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` at positions lo to hi, hi exclusive."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of ``token``, or -1."""
        if token >> self.bits:
            return -1
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i = lo + j
        for k in range(self.bits - 1, -1, -1):
            i = self._select(k, 1, i - self.zeros[k]) if token >> (self.bits - 1 - k) & 1 else self._select(k, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence, undoing the deals from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            above = np.empty(self.n, kind)
            above[~bit] = now[: self.zeros[k]]
            above[bit] = now[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            now = above
        return now
