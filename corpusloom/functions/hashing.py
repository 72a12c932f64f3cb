"""Vectorised 64-bit hashing and Bloom filters in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U)
    k, b = 1, base
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(b)
        b, k = b * b % 2**64, k + m
    return out


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept between calls up to 4M."""
    if len(_Powers.up) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = _powers(_BASE, size), _powers(_INVERSE, size)
        if size > 1 << 22:
            return up, down
        _Powers.up, _Powers.down = up, down
    return _Powers.up, _Powers.down


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit symbols, by prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h ^ ((end - start).astype(U) << U(44)))


def bloom_probes(h: np.ndarray, bits: int, k: int = 4) -> list[np.ndarray]:
    a, b = h.astype(U), mix(h.astype(U) ^ U(0xA5A5A5A5A5A5A5A5)) | U(1)
    return [((a + U(i) * b) & U(bits - 1)).astype(np.int64) for i in range(k)]


def bloom_bits(n: int, per_key: int = 10, max_bytes: int = 16 << 20) -> int:
    """A power of two of bits for n keys, at most max_bytes."""
    return min(1 << max(13, (n * per_key - 1).bit_length()), max_bytes * 8)


def bloom_add(filt: np.ndarray, h: np.ndarray, k: int = 4) -> None:
    """filt: one byte a bit."""
    for p in bloom_probes(h, len(filt), k):
        filt[p] = 1


def bloom_has(packed: np.ndarray, h: np.ndarray, k: int = 4) -> np.ndarray:
    """packed: np.packbits(filt, bitorder='little')."""
    ok = np.ones(len(h), bool)
    for p in bloom_probes(h, len(packed) * 8, k):
        ok &= (packed[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return ok
