"""Exact quantiles by selection against NumPy: ties, nulls, few rows, brackets of any width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import aggregates, quantiles


@pytest.mark.parametrize("accuracy", [5, 50, 10_000])
def test_quantiles(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=5000), 1: rng.integers(0, 4, 3000) * 1.0, 2: np.array([2.5]), 3: np.full(100, 7.0), 4: np.array([1.0, 2.0]), None: rng.exponential(size=701), 5: np.append(np.zeros(999), 1.0)}
    rows = [(k, float(x), None) for k, xs in groups.items() for x in xs] + [(6, None, None), (0, None, None), (1, float("nan"), None)]
    df = spark.createDataFrame(rows, "g int, x double, k int").repartition(8)
    shares = {"least": 0.0, "q1": 0.25, "mid": 0.5, "high": 0.9, "most": 1.0}
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "x", shares, accuracy).collect()}
    assert set(got) == {*groups, 6} and got[6].mid is None
    for g, xs in groups.items():
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, share), abs=1e-12), (g, name)
    assert quantiles.quantiles(df.limit(0), ["g"], "x", shares).count() == 0
    assert quantiles.quantiles(df.where("g = 0"), [], "x", {"mid": 0.5}).first().mid == pytest.approx(np.median(groups[0]), abs=1e-12)


def test_robust_and_series(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=4001)
    df = spark.createDataFrame([(1, float(v)) for v in x] + [(2, 3.0), (3, None)], "g int, x double")
    got = {r.g: r for r in aggregates.robust(df, ["g"], "x").collect()}
    assert got[1].centre == pytest.approx(np.median(x), abs=1e-12) and got[1].spread == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))), abs=1e-9)
    assert (got[2].centre, got[2].spread, got[3].centre, got[3].spread) == (3.0, 0.0, None, None)
    stats = {r.g: r for r in aggregates.series_stats(df, ["g"], "x").collect()}
    assert stats[1].n == 4001 and stats[1].p90 == pytest.approx(np.quantile(x, 0.9), abs=1e-12) and stats[3].n == 0 and stats[3].p50 is None


def test_one_group_of_nearly_all_rows_uses_all_tasks(spark):
    """The rows of a group are counted where they lie: what is shuffled is a few rows a task and the inside of the bracket."""
    df = spark.range(0, 400_000, 1, 16).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 400_009).cast("double").alias("x"))
    xs = np.arange(400_000) * 7919 % 400_009
    got = quantiles.quantiles(df, ["g"], "x", {"mid": 0.5}).first()
    assert got.mid == np.median(xs)


def test_interpolated_with_one_rounding(spark):
    """The weighed sum of two values is rounded once, as whole fractions tell."""
    import math
    import random
    from fractions import Fraction

    rng = random.Random(4)
    groups = {g: sorted(rng.choice([round(rng.random() * 490, 2), 7.13]) for _ in range(rng.choice([1, 2, 23, 25, 66]))) for g in range(300)}
    df = spark.createDataFrame([*((g, v) for g, vs in groups.items() for v in vs), (0, None), (999, None)], "g int, v double")
    for share in (0.05, 0.8, 0.9):
        want = {}
        for g, vs in groups.items():
            at = (len(vs) - 1) * share
            low, part = math.floor(at), at - math.floor(at)
            want[g] = vs[low] if part == 0 else float(Fraction(vs[low]) * Fraction(1 - part) + Fraction(vs[low + 1] * part))
        assert {r.g: r.q for r in quantiles.interpolated(df, ["g"], "v", share, "q").collect()} == want
