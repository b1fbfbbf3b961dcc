"""Vectorised rolling hashes over the bytes of many texts at once."""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_GOLD = np.uint64(_BASE)


@functools.cache
def _bytes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


_held: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, held for the largest size asked for so far."""
    if not _held or _held[0].size <= n:
        size = 1 << max(16, int(n).bit_length())
        _held[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _held[0], _held[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of substrings of ``data`` by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(data.size)
        self.sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(_bytes()[data] * up[: data.size], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each substring; equal bytes hash alike wherever they are."""
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _GOLD)

    def every(self, length: int) -> np.ndarray:
        """Hash of the substring of ``length`` at every position."""
        n = self.sums.size - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])
