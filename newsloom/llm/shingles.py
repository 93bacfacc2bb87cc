"""Sets of word shingles as sorted 64-bit numbers.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A document's set holds its
distinct runs of ``WIDTH`` words, or with fewer words the whole sequence.  All words
of a batch are hashed at once: a prefix sum of byte values times powers of an odd
number gives every word's polynomial, which is then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .batches import flat_bytes

WIDTH = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    def __init__(self, width: int = WIDTH):
        self.width = width
        self.values = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))[_LOWER]
        self.up = self.down = np.zeros(0, _U)

    def sums(self, data: np.ndarray, at: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the bytes' values times powers, with ``data`` at the places ``at``, and the powers' inverses."""
        if len(self.up) < len(outside):
            self.up = _powers(_BASE, len(outside) * 5 // 4)
            self.down = _powers(pow(_BASE, -1, 1 << 64), len(outside) * 5 // 4)
        out = np.zeros(len(outside), _U)
        out[at] = self.values[data]
        out *= self.up[: len(outside)]
        out[outside] = 0
        return np.cumsum(out, out=out), self.down

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Every word's hash and each row's number of words."""
        data, bounds = flat_bytes(column)
        rows = len(bounds) - 1
        row = np.repeat(np.arange(rows), np.diff(bounds))
        inside = np.zeros(len(data) + rows + 2, bool)
        at = np.arange(1, len(data) + 1) + row  # a gap parts the rows
        inside[at] = ~_SPACE[data]
        sums, down = self.sums(data, at, ~inside)
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
        ends = bounds[1:] + np.arange(1, rows + 1)
        return hashes, np.diff(np.searchsorted(start, np.concatenate(([0], ends))))

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """Each row's shingles, sorted and distinct."""
        hashes, sizes = self.words(column)
        step = [_U(pow(0xA24BAED4963EE407, k + 1, 1 << 64)) for k in range(self.width)]
        n = max(0, len(hashes) - self.width + 1)
        runs = np.zeros(n, _U)
        for k in range(self.width):
            runs += hashes[k : k + n] * step[k]
        runs = mix(runs)
        out, begin = [], 0
        for size in sizes.tolist():
            if size >= self.width:
                out.append(np.unique(runs[begin : begin + size - self.width + 1]))
            elif size:
                few = sum((hashes[begin + k : begin + k + 1] * step[k] for k in range(size)), np.zeros(1, _U))
                out.append(mix(few + _U(size)))
            else:
                out.append(np.zeros(0, _U))
            begin += size
        return out
