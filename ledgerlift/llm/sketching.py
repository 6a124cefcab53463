"""Fast similarity sketching: t coordinates of a set, each a minimum; equal in two sets with their Jaccard similarity.

Round i throws every element into one of the t bins by a hash, with the value (i, hash); a bin keeps its least value.
After a round in which all bins are filled, no later round can lower a value, and the rounds stop. From round t on,
round t + j throws all elements into bin j, so that every bin is filled after 2t rounds at most. The bins behave like
sampling without replacement, hence the concentration bounds; the work is O(n + t log t) for most sets.
"""

from __future__ import annotations

import numpy as np

from .shingles import M1, mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketches [len(sets), t] of nonempty sets; t is a power of two, at most 128."""
    bins = np.full((len(sets), t), EMPTY)
    flat = bins.reshape(-1)
    if not sets:
        return bins
    value = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets), dtype=np.int64) * t, [len(s) for s in sets])
    shift = np.uint64(64 - t.bit_length() + 1)
    low = np.uint64((1 << 56) - 1)
    for i in range(2 * t):
        h = mix(value * M1 + np.uint64(2 * i + 1))
        at = base + (h >> shift).astype(np.int64) if i < t else base + (i - t)
        np.minimum.at(flat, at, np.uint64(i << 56) | (h & low))
        open_ = (bins == EMPTY).any(axis=1)
        if not open_.any():
            break
        still = open_[base // t]
        value, base = value[still], base[still]
    return bins
