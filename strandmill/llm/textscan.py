"""Vectorised scanning of UTF-8 text slices: words, hashes, sets."""

from __future__ import annotations

import numpy as np

_M = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte.
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
#: The blanks 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes hashed at once, whatever the length of a slice.
BLOCK = 1 << 18
#: Powers of the hash base and of its inverse modulo 2**64.
_pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, _P, np.uint64)]))
_inv = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, _PINV, np.uint64)]))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _M(30)
    h *= _M(0xBF58476D1CE4E5B9)
    h ^= h >> _M(27)
    h *= _M(0x94D049BB133111EB)
    h ^= h >> _M(31)
    return h


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the byte values times the powers of the base, over at most BLOCK bytes."""
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * _pow[: len(data)], out=acc[1:])
    return acc


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of ascending byte spans; equal bytes give equal hashes wherever they stand.

    Works in blocks of bytes, so a text of any length takes 16 bytes of memory for each span beyond its own.
    """
    h = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + BLOCK, side="right"))
        if j > i:
            acc = _sums(data[base : int(ends[j - 1])])
            lo = starts[i:j] - base
            h[i:j] = (acc[ends[i:j] - base] - acc[lo]) * _inv[lo]
        else:  # one span above a block
            j, total = i + 1, 0
            for at in range(base, int(ends[i]), BLOCK):
                part = int(_sums(data[at : min(at + BLOCK, int(ends[i]))])[-1])
                total += part * pow(_P, at - base, 1 << 64)
            h[i] = total % (1 << 64)
        i = j
    return mix(h + (ends - starts).astype(np.uint64) * _M(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document its first word (n+1 entries)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begin = word & cut[:-1]
    begin[1:] |= word[1:] & ~word[:-1]
    end = word & cut[1:]
    end[:-1] |= word[:-1] & ~word[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(h)-k+1 entries)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out *= _M(0x9FB21C651E98DF25)
        out += h[j : j + m]
    return mix(out)
