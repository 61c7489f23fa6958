"""Vectorised words and shingles of whole texts.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased; hashes are 64-bit and depend
on nothing but the bytes, so every executor gives the same.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes) and hashes of the words of lower-cased UTF-8."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.ones(len(raw) + 2, bool)
    edge[1:-1] = SPACE[raw]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = turns[0::2], turns[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """One hash for each run of ``size`` words; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * _PLACE[j]
    return mix(total)
