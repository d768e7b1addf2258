"""Words of a batch as numbers, and hashed character n-grams of its distinct words."""

from __future__ import annotations

import numpy as np
import pandas as pd

_A = 0x9E3779B97F4A7C15


def numbered(lists: list[list]) -> tuple[np.ndarray, list, np.ndarray]:
    """Word numbers of texts end to end, the distinct words, the number of words of each text."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for ws in lists for w in ws]
    codes, names = pd.factorize(flat)
    return codes, list(names), sizes


def word_grams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of <word>, all words end to end; each word's first and number.
    Every word of at least one byte has n-grams as long as min(sizes) is 3 or less."""
    raw = [b"<" + w + b">" for w in words]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(n)
    own = np.repeat(np.arange(len(raw)), n)
    at, whose = [], []
    with np.errstate(over="ignore"):
        for size in sizes:
            p = np.arange(max(0, len(data) - size + 1))
            p = p[p + size <= ends[own[p]]]
            h = np.full(len(p), size, np.uint64)
            for k in range(size):
                h = (h ^ data[p + k]) * np.uint64(_A)
                h ^= h >> np.uint64(32)
            at.append((h >> np.uint64(20)).astype(np.int64) % buckets)
            whose.append(own[p])
    whose_all = np.concatenate(whose) if whose else np.zeros(0, np.int64)
    order = np.argsort(whose_all, kind="stable")
    count = np.bincount(whose_all, minlength=len(raw))
    return np.concatenate(at)[order], np.cumsum(count) - count, count
