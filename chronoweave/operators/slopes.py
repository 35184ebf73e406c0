"""Median of the slopes of all pairs of points, without the pairs.

A pair's slope is under m if its order by x and by the rest y - m x differ, so the pairs under m are the inversions between two
sortings. The median is bracketed by drawn pairs, the bracket halved by counts of inversions until few pairs lie inside, and
only those are listed; their slopes are then taken as they are, so the result is that of all pairs, ties included.
"""

from __future__ import annotations

import numpy as np

#: Pairs that are listed at once, drawn pairs, and halvings at most (beyond those, all slopes in the bracket are one number).
LISTED, DRAWN, HALVINGS = 2_000_000, 100_000, 80


def _inversions(values: np.ndarray, listed: bool = False):
    """How many pairs of places a < b have values[a] > values[b], or these places as two arrays. Merged from blocks of one, two, four ... places, all blocks of a size at once."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    size = 1 << max(1, (n - 1).bit_length())
    rank = np.append(rank, np.arange(n, size))
    count, firsts, seconds = 0, [], []
    width = 1
    while width < size:
        rows = rank.reshape(-1, 2 * width)
        lift = np.arange(len(rows))[:, None] * size
        left, right = (rows[:, :width] + lift).ravel(), (rows[:, width:] + lift).ravel()
        upto = np.searchsorted(left, right)
        end = (np.arange(len(right)) // width + 1) * width
        count += int((end - upto).sum())
        if listed and count:
            many = end - upto
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(upto, many)
            firsts.append(left[at] % size), seconds.append(np.repeat(right % size, many))
        rank = np.sort(rows, axis=1).ravel()
        width *= 2
    if not listed:
        return count
    return tuple(order[np.concatenate(v)] if v else np.zeros(0, np.int64) for v in (firsts, seconds))


def median_slope(x: np.ndarray, y: np.ndarray, listed: int = LISTED, seed: int = 3) -> tuple[float | None, int]:
    """The median slope over pairs of points of different x, and how many pairs there are."""
    n = len(x)
    _, same = np.unique(x, return_counts=True)
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return None, 0
    ranks = ((pairs - 1) // 2, pairs // 2)

    def chosen(a: np.ndarray, b: np.ndarray, below: int) -> float:
        slopes = (y[b] - y[a]) / (x[b] - x[a])
        found = np.partition(slopes, [r - below for r in ranks])
        return float(0.5 * found[ranks[0] - below] + 0.5 * found[ranks[1] - below])

    if pairs <= listed and n * (n - 1) // 2 <= 2 * listed:
        a, b = np.triu_indices(n, 1)
        other = x[a] != x[b]
        return chosen(a[other], b[other], 0), pairs

    def under(m: float) -> int:
        rest = y - m * x
        return _inversions(rest[np.lexsort((rest, x))])

    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, n, (DRAWN, 2))
    draw = draw[x[draw[:, 0]] != x[draw[:, 1]]]
    slopes = np.sort((y[draw[:, 1]] - y[draw[:, 0]]) / (x[draw[:, 1]] - x[draw[:, 0]]))
    span = max(1.0, float(np.abs(slopes).max()))
    reach = int(3 * np.sqrt(max(1, len(slopes)))) + 1
    low, high = (float(slopes[min(max(k, 0), len(slopes) - 1)]) for k in (len(slopes) // 2 - reach, len(slopes) // 2 + reach))
    low, high = low - 1e-9 * span, high + 1e-9 * span
    below, upto = under(low), under(high)
    while below > ranks[0]:
        low -= (high - low) + 1e-9 * span
        below = under(low)
    while upto <= ranks[1]:
        high += (high - low) + 1e-9 * span
        upto = under(high)
    for _ in range(HALVINGS):
        middle = 0.5 * (low + high)
        if upto - below <= listed or not low < middle < high:
            break
        now = under(middle)
        if now <= ranks[0]:
            low, below = middle, now
        elif now > ranks[1]:
            high, upto = middle, now
        else:  # the two middle slopes lie to either side
            break
    if upto - below > 4 * listed:
        # Nearly all pairs of the bracket have one slope; those drawn at random show it best, else the bracket's middle is as near as a double can be.
        inside = slopes[(slopes >= low) & (slopes <= high)]
        return (float(np.median(inside)) if len(inside) else 0.5 * (low + high)), pairs
    rest = y - low * x
    order = np.lexsort((x, rest))
    a, b = _inversions((y - high * x)[order], listed=True)
    return chosen(order[a], order[b], below), pairs
