"""Prefix polynomial hashes of byte strings modulo 2**64.

P[i] is the sum of (byte + 1) * BASE**k over the first i bytes, so any substring's
hash is one difference and one multiplication by an inverse power: substrings of
equal content have equal hashes wherever they lie.
"""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits; one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (BASE, INVERSE))
    return _powers


def forget() -> None:
    """Drop the powers that are kept."""
    global _powers
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """P for every prefix of the bytes, the empty one included."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def window_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of this size."""
    n = len(prefix) - size
    return (prefix[size:] - prefix[:n]) * powers(len(prefix))[1][:n]
