"""Five-word shingles of whole texts as sets of 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from placewise.llm.common import lower_ascii, mix, steps, word_bounds, word_hashes

WORDS = 5
_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles: of all runs of five words, or of its whole
    sequence if it has fewer; none for a row without words. A-Z are lower-cased."""
    for i, j in steps(bounds):
        part, own = lower_ascii(data[bounds[i] : bounds[j]]), bounds[i : j + 1] - bounds[i]
        starts, ends, counts = word_bounds(part, own)
        words = word_hashes(part, starts, ends)
        n = max(0, len(words) - WORDS + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(WORDS):
            runs += words[k : k + n] * _FACTORS[k]
        runs = mix(runs)
        first = np.cumsum(counts) - counts
        for a, c in zip(first, counts, strict=True):
            if c >= WORDS:
                yield np.unique(runs[a : a + c - WORDS + 1])
            elif c:
                yield mix((words[a : a + c] * _FACTORS[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c))
            else:
                yield np.zeros(0, np.uint64)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    return a, mix(a)


def signature(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least hash under each permutation; own isn't empty."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 512):
        x = own[i : i + 512, None] * a[None, :] + b[None, :]
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
