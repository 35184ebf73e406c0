"""Median slopes by counting inversions against all pairs."""

import time

import numpy as np
import pytest

from chronoweave.operators import aggregates, slopes


def plain(x, y):
    a, b = np.triu_indices(len(x), 1)
    other = x[a] != x[b]
    s = (y[b] - y[a])[other] / (x[b] - x[a])[other]
    return (float(np.median(s)) if len(s) else None), len(s)


@pytest.mark.parametrize("listed", [10, 300, 2_000_000])
def test_against_all_pairs(listed):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 60, 301):
        for kind in range(5):
            x = rng.normal(size=n) if kind < 2 else rng.integers(0, 12, n) * 1.0
            y = [rng.normal(size=n), 3 * x + rng.normal(size=n) * 0.01, rng.integers(0, 3, n) * 1.0, np.full(n, 2.0), x * 0.5][kind]
            got, want = slopes.median_slope(x, y, listed), plain(x, y)
            assert got[1] == want[1]
            assert got[0] == want[0] or got[0] == pytest.approx(want[0], rel=1e-12, abs=1e-12), (n, kind)


def test_inversions():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        v = rng.integers(0, 20, n)
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if v[a] > v[b]}
        assert slopes._inversions(v) == len(want)
        a, b = slopes._inversions(v, listed=True)
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_large_key(spark):
    """A key of 100,000 points takes seconds; the median of its five thousand million pairs has half of them under it."""
    rng = np.random.default_rng(5)
    n = 100_000
    x, y = rng.normal(size=n), rng.normal(size=n)
    y += 0.25 * x
    began = time.time()
    slope, pairs = slopes.median_slope(x, y)
    assert time.time() - began < 60 and pairs == n * (n - 1) // 2 and abs(slope - 0.25) < 0.05
    rest = y - slope * x
    under = slopes._inversions(rest[np.lexsort((rest, x))])
    assert abs(under - pairs / 2) <= 2


def test_by_key(spark):
    rng = np.random.default_rng(6)
    groups = {g: (rng.integers(0, 30, n) * 1.0, rng.normal(size=n)) for g, n in enumerate((1, 2, 5, 64, 65, 200, 700))}
    rows = [(g, float(a), float(b), None) for g, (x, y) in groups.items() for a, b in zip(x, y)] + [(9, None, 1.0, None), (9, 1.0, None, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double, slope double").repartition(5)
    got = {r.g: (r.slope, r.pairs) for r in aggregates.theil_sen(df, ["g"], "x", "y").collect()}
    for g, (x, y) in groups.items():
        slope, pairs = plain(x, y)
        assert (g in got) == (pairs > 0)
        if pairs:
            assert got[g][1] == pairs and got[g][0] == pytest.approx(slope, abs=1e-12)
