"""Vectorised 64-bit hashes of the words and word windows of many texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  A word's hash
is a polynomial over a random byte table, modulo 2**64, followed by a mixer; it
depends on the word alone, so it agrees between tasks, executors and runs.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20


def _table(seed: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BYTES = _table(20240)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64 arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))) + np.uint64(1))


def _hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power = _power(_BASE, len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * power, out=total[1:])
    inverse = _power(pow(_BASE, -1, 1 << 64), len(raw) + 1)
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + lengths)


def words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and len(texts)+1 offsets into them.

    A null or blank text has no words.  lower maps A-Z to a-z first.
    """
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    parts: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < _BLOCK):
            size += len(texts[end] or b"") + 1
            end += 1
        raw = np.frombuffer(b"\n".join(t or b"" for t in texts[at:end]) + b"\n", dtype=np.uint8)
        if lower:
            raw = _LOWER[raw]
        blank = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        parts.append(_hash_runs(raw, starts, ends))
        limits = np.cumsum([len(t or b"") + 1 for t in texts[at:end]])
        counts[at + 1 : end + 1] = np.diff(np.searchsorted(starts, limits), prepend=0)
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n neighbouring hashes (none if there are fewer)."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = combine(out, hashes[k : len(hashes) - n + 1 + k])
    return out
