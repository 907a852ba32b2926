"""Hashes of many short byte strings at once, with numpy."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of spans of a byte array, from running sums of one polynomial."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            self._up, self._down = powers(_BASE, n), powers(_INVERSE, n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self._down[start] + (end - start).astype(np.uint64))


class Sequence:
    """64-bit hashes of any stretch of a sequence of numbers."""

    def __init__(self, numbers: np.ndarray) -> None:
        up, self.down = powers(_BASE, len(numbers)), powers(_INVERSE, len(numbers) + 1)
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(mix(numbers.astype(np.uint64)) * up[: len(numbers)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def common(a: Sequence, i: np.ndarray, b: Sequence, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How many numbers, at most `most`, the sequences share from places i and j on (back: before them), by bisection."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
    while (low < high).any():
        n = (low + high + 1) // 2
        same = a.hashes(i - n, n) == b.hashes(j - n, n) if back else a.hashes(i, n) == b.hashes(j, n)
        low, high = np.where(same, n, low), np.where(same, high, n - 1)
    return low
