"""Word handling on Arrow batches: whole batches become flat integer arrays for numpy."""

from __future__ import annotations

import re

import numpy as np

#: An unbroken run of letters and digits; the same runs as the JVM's ``[\\p{L}\\p{N}]+``.
WORD = re.compile(r"[^\W_]+")

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = (x + _MIX[0]).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive ids (empty if there are fewer)."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = mix64(h * _MIX[1] + ids[k : k + m])
    return h
