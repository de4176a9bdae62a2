"""Min-max sketches of word-shingle sets (Ji et al. 2013): both extremes under each permutation.

For a pair of sets either extreme agrees with probability equal to their Jaccard similarity, so P
permutations give 2P signature values for P hash evaluations; as the two extremes of one permutation are
negatively correlated, the estimate varies less than with 2P separate minima.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kgspark.llm.common import Words, splitmix, spread, windows

_MULTIPLIERS = splitmix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and offsets of the texts in them.

    A text of fewer than k words has its whole word sequence as its one shingle; one without words has none.
    """
    w = Words(texts, lower=lower)
    h, n = w.hashes(), w.counts()
    at = spread(w.first, k)
    grams = windows(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.searchsorted(w.first, at, side="right") - 1
    if len(short := np.flatnonzero((n > 0) & (n < k))):
        whole = np.array([windows(h[w.first[i] : w.first[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short], np.uint64)
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(n) + 1))


def sketches(grams: np.ndarray, off: np.ndarray, perms: int) -> np.ndarray:
    """2 * perms values for each text: minima, then maxima. Texts without shingles get zeros."""
    full = np.flatnonzero(np.diff(off) > 0)
    out = np.zeros((len(off) - 1, 2 * perms), np.uint64)
    if len(full):
        starts = off[full]
        for p in range(perms):
            x = grams * _MULTIPLIERS[p]
            x ^= x >> np.uint64(29)
            out[full, p] = np.minimum.reduceat(x, starts)
            out[full, perms + p] = np.maximum.reduceat(x, starts)
    return out


def band_values(perms: int, rows: int) -> list[list[int]]:
    """Which values of a sketch each band takes: minima and, from other permutations, as many maxima."""
    bands, half = 2 * perms // rows, rows // 2
    if rows % 2 or 2 * perms % rows:
        raise ValueError("rows must be even and divide twice the number of permutations")
    low = [[b + r * bands for r in range(half)] for b in range(bands)]
    return [own + [perms + (p + bands // 2) % perms for p in own] for own in low]


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` values, all of different permutations."""
    values = band_values(sketch.shape[1] // 2, rows)
    out = np.empty((len(sketch), len(values)), np.uint64)
    for b, own in enumerate(values):
        key = np.full(len(sketch), b + 1, np.uint64)
        for v in own:
            key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) ^ sketch[:, v])
        out[:, b] = key
    return out
