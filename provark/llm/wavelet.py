"""Wavelet matrix over ranks, with weights: how many entries of a prefix are greater than a bound."""

from __future__ import annotations

import numpy as np


def prefix_greater(ranks: np.ndarray, weights: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query k: the number, and the weight, of entries among ranks[: ends[k]] that are greater than bounds[k].

    A plane holds one bit of every rank, highest bit first, with prefix sums of its ones and of their weights; the next
    plane has the zeros of this one, then its ones, each in their order. A query is an interval of the plane: at a bit
    0 of its bound the ones of the interval are greater and counted, and it goes on among the zeros; at a bit 1 it goes
    on among the ones. All queries pass a plane before the next one is built, so memory does not follow the planes."""
    counts, sums = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    if not len(ranks) or not len(ends):
        return counts, sums
    ranks, weights, low, high = ranks.astype(np.int64), weights.astype(np.int64), np.zeros(len(ends), np.int64), ends.astype(np.int64)
    for plane in reversed(range(int(max(ranks.max(), bounds.max())).bit_length())):
        ones = (ranks >> plane) & 1 == 1
        before, heavy = (np.concatenate([[0], np.cumsum(np.where(ones, x, 0))]) for x in (1, weights))
        above = (bounds >> plane) & 1 == 0
        counts[above] += (before[high] - before[low])[above]
        sums[above] += (heavy[high] - heavy[low])[above]
        zeros = len(ranks) - before[-1]
        low, high = (np.where(above, x - before[x], zeros + before[x]) for x in (low, high))
        ranks, weights = (np.concatenate([x[~ones], x[ones]]) for x in (ranks, weights))
    return counts, sums
