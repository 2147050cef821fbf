"""Vectorized prefix polynomial hashes over bytes, and content-defined anchors.

Hashes are polynomials modulo 2**64 over a table of random byte values, from prefix sums: any substring's hash takes one
subtraction and one multiplication. Equal strings have equal hashes; callers verify what must be certain.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: An odd base and the seed of the byte table.
BASE, SEED = 0x9E3779B97F4A7C15, 20_240_607
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(4)
def byte_table(seed: int) -> np.ndarray:
    """Random odd values of the bytes; another seed is another hash function."""
    return np.random.default_rng(SEED + seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n-1."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """P[i] = sum of byte_table[data[j]] * BASE**j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table(seed)[data] * powers(len(data))[0], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """The hash of each substring, whatever its place."""
    return (prefix[start + length] - prefix[start]) * powers(len(prefix))[1][start]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width], for every i that has so many values."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(prefix: np.ndarray, ends: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor positions, first and last window start of each) of texts that end at ``ends``.

    Each window of ``window`` bytes within one text chooses the places of its smallest mixed ``gram``-byte hash; equal
    windows choose equal places, in whatever text they stand.
    """
    n = len(prefix) - 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    inv = powers(len(prefix))[1]
    h = (prefix[gram:] - prefix[:-gram]) * inv[: n - gram + 1]
    v = (mix(h) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    span = window - gram + 1
    least = _slide(v, span, np.minimum)  # one for each window start
    valid = np.ones(len(least), bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - window + 1) : e] = False
    least = np.where(valid, least, np.uint32(0))
    pad = np.zeros(span - 1, np.uint32)
    top = _slide(np.concatenate([pad, least, pad]), span, np.maximum)  # over window starts i - span + 1 .. i
    at = np.flatnonzero(top[: len(v)] == v)
    # The windows that chose an anchor are those within reach whose minimum is its value.
    reach = at[:, None] - np.arange(span - 1, -1, -1)[None, :]
    inside = (reach >= 0) & (reach < len(least))
    chose = np.where(inside, least[np.clip(reach, 0, len(least) - 1)], 0) == v[at][:, None]
    first = at - (span - 1) + chose.argmax(axis=1)
    last = at - chose[:, ::-1].argmax(axis=1)
    return at, first, last
