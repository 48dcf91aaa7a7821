"""Hashes of all words or byte windows of a text, with numpy, and payloads that carry them between tasks.

Windows are named by polynomial hashes modulo 2^64 over keyed byte values, taken from prefix sums and mixed. Names of a
kind that decides something are compared at 96 bits or more.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 4096
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Tab to carriage return, and space.
_GAPS = (9, 10, 11, 12, 13, 32)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        values = mix((np.arange(256, dtype=U) + U(1)) * U(0xD6E8FEB86659FD93))
        if name == "lower":
            values[65:91] = values[97:123]
        gaps = np.zeros(256, bool)
        gaps[list(_GAPS)] = True
        _tables[name] = gaps if name == "gaps" else values
    return _tables[name]


def _powers(n: int, base: int) -> np.ndarray:
    key = f"powers{base}"
    have = _tables.get(key)
    if have is None or len(have) < n:
        size = max(n, 2 * len(have) if have is not None else 1 << 14)
        with np.errstate(over="ignore"):
            have = _tables[key] = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, base & 0xFFFFFFFFFFFFFFFF, U)]))
    return have[:n]


class Prefix:
    """Prefix sums of a byte array; ``window(starts, ends)`` names its parts."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        values = _table("lower" if lower else "plain")[data]
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(values * _powers(len(data), _INVERSE), out=self.sums[1:])
        self.scale = _powers(len(data) + 1, _BASE)

    def window(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.scale[starts] + (ends - starts).astype(U))

    def every(self, k: int) -> np.ndarray:
        """Names of all windows of ``k`` bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.scale[:n] + U(k))


class Runs:
    """Prefix sums of a sequence of 64-bit names; ``window(starts, ends)`` names its runs, never with 0."""

    def __init__(self, names: np.ndarray):
        self.sums = np.zeros(len(names) + 1, U)
        np.cumsum(mix(names) * _powers(len(names), _INVERSE), out=self.sums[1:])
        self.scale = _powers(len(names) + 1, _BASE)

    def window(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.scale[starts] + (ends - starts).astype(U)) | U(1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than tab, newlines and space."""
    inside = np.concatenate([[False], ~_table("gaps")[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """One 64-bit name for each word, in order; A-Z count as a-z."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    return Prefix(data, lower).window(starts, ends) if len(starts) else np.zeros(0, U)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct names of the runs of ``n`` words; of fewer words, the whole sequence is one."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = mix(out * U(0x9FB21C651E98DF25) + words[i : len(words) - k + 1 + i])
    return np.unique(out + U(k))


def pack(values: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of each 64-bit value, as rows of bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def unpack(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u8").ravel()
