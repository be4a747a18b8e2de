"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, down: bool = False) -> np.ndarray:
    """Powers 0..n-1 of an odd base (or of its inverse) modulo 2**64."""
    key = "down" if down else "up"
    if len(_powers[key]) < n:
        table = np.full(max(n, 1 << 20), _INVERSE if down else _BASE, np.uint64)
        table[0] = 1
        _powers[key] = np.cumprod(table)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of value * base**i; with ``span_hash`` any stretch gets a hash that depends on its content alone."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = (sums[end] - sums[start]) * powers(len(sums), down=True)[start]
    return mix(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray  # row of the text
    first: np.ndarray  # len(rows) + 1: the first word of each row


def words(flat: np.ndarray, at: np.ndarray, gaps: np.ndarray = GAPS) -> Words:
    """Runs of bytes that are no gaps; no word crosses from one text to the next."""
    inside = ~gaps[flat]
    n = len(flat)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside])
    opens = inside & (~before[:-1] | edge[:-1])
    after = np.concatenate([inside[1:], [False]]) if n else inside
    closes = inside & (~after | edge[1:])
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, at)
    return Words(start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def word_hashes(flat: np.ndarray, w: Words) -> np.ndarray:
    return span_hash(prefix(_VALUES[flat]), w.start, w.end)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (the last k - 1 places do not count)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
    return mix(out)
