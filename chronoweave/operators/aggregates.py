"""Aggregations: robust statistics, regressions, binned means, votes and profiles.

Nulls in a value don't count; rows with a null key are a group of their own; ties are resolved as each docstring says; an
empty table gives no groups.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import quantiles, slopes


def series_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, least, greatest, exact median and 90th percentile (linear interpolation), mean and population deviation."""
    v = F.col(value)
    plain = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))
    ranks = quantiles.quantiles(df, keys, value, {"p50": 0.5, "p90": 0.9})
    return quantiles.equal_join(plain, ranks, keys).select(*keys, "n", "least", "greatest", "p50", "p90", "mean", "deviation")


def robust(df: DataFrame, keys: list[str], value: str, factor: float = 1.4826) -> DataFrame:
    """centre (median) and spread (scaled median absolute deviation), in two passes."""
    return quantiles.robust(df, keys, value, factor)


def fit_line(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 2, limit: float = 2.5) -> DataFrame:
    """slope, intercept and n of a least-squares line; each further round leaves rows out whose residual is over ``limit`` deviations."""
    rows = df
    for k in range(rounds):
        line = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
        if k == rounds - 1:
            return line
        away = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
        with_line = rows.join(line, keys).withColumn("_r", away)
        spread = with_line.groupBy(*keys).agg(F.stddev_pop("_r").alias("_s"))
        rows = with_line.join(spread, keys).where(F.abs("_r") <= limit * F.col("_s") + 1e-12).select(*df.columns)
    return rows


#: Points of a key up to which its pairs are made.
FEW_POINTS = 64


def theil_sen(df: DataFrame, keys: list[str], x: str, y: str, few: int = FEW_POINTS) -> DataFrame:
    """Median slope over pairs of points of different x, and the number of pairs, by key (keys aren't null). Pairs of keys of ``few`` points are made inside their row; of a larger key no pair is made but the few whose slopes may be the median (``slopes``), from its points in one task, 16 bytes each."""
    points = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    points = points.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    sized = points.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    # Few points travel as one array; its pairs are never rows.
    packed = sized.where(F.col("_n") <= few).groupBy(*keys).agg(F.collect_list(F.struct("_x", "_y")).alias("_p"))
    steps = F.expr("sort_array(flatten(transform(_p, a -> transform(filter(_p, b -> a._x < b._x), b -> (b._y - a._y) / (b._x - a._x)))))")
    small = packed.select(*keys, steps.alias("_s")).where("size(_s) > 0").select(*keys, F.expr("0.5D * get(_s, (size(_s) - 1) div 2) + 0.5D * get(_s, size(_s) div 2)").alias("slope"), F.size("_s").cast("long").alias("pairs"))
    kinds = dict(df.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        # The order of rows must not change which pairs are drawn.
        part = part.sort_values(["_x", "_y"])
        slope, pairs = slopes.median_slope(part["_x"].to_numpy(), part["_y"].to_numpy())
        return part[keys].head(1).assign(slope=slope, pairs=pairs) if pairs else part[keys].head(0).assign(slope=0.0, pairs=0)

    large = sized.where(F.col("_n") > few).drop("_n").groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "slope double", "pairs long"]))
    return small.unionByName(large)


def robust_line(df: DataFrame, keys: list[str], x: str, y: str, spreads: float = 3.0, least: float = 1e-3) -> DataFrame:
    """slope, intercept, error (of the slope) and n of a least-squares line through the points within ``spreads`` scaled median deviations (``least`` at least) of the line of median slope and median rest."""
    slope = theil_sen(df, keys, x, y).select(*keys, F.col("slope").alias("_s"))
    rest = df.join(slope, keys).withColumn("_e", F.col(y) - F.col("_s") * F.col(x))
    # Medians over a key's rows where they lie: they are not shuffled again.
    whole = Window.partitionBy(*keys)
    away = rest.withColumn("_i", F.median("_e").over(whole)).withColumn("_r", F.abs(F.col("_e") - F.col("_i")))
    near = away.withColumn("_d", 1.4826 * F.median("_r").over(whole)).where(F.col("_r") <= F.greatest(spreads * F.col("_d"), F.lit(least)))
    fit = near.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("_xx"), F.regr_sxy(y, x).alias("_xy"), F.regr_syy(y, x).alias("_yy"), F.count("*").alias("n"))
    left = F.greatest(F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx"), F.lit(0.0))
    return fit.withColumn("error", F.sqrt(left / F.greatest(F.lit(1), F.col("n") - 2) / F.col("_xx"))).drop("_xx", "_xy", "_yy")


def duplicate_keys(df: DataFrame, key: str, item: str) -> DataFrame:
    """Keys found more than once: count and the first and last item."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(item).alias("first"), F.max(item).alias("last")).where("n > 1")


def binned_means(df: DataFrame, keys: list[str], t: str, value: str, width, low: int, high: int) -> DataFrame:
    """Mean per bin of [low, high); a bin without samples has 0."""
    seen = df.withColumn("bin", F.floor(F.col(t) / width).cast("long")).where(F.col("bin").between(low, high - 1)).groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    bins = df.select(*keys).distinct().withColumn("bin", F.explode(F.expr(f"sequence({low}L, {high - 1}L)")))
    return bins.join(seen, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def best_phase(df: DataFrame, keys: list[str], i: str, value: str, period: int) -> DataFrame:
    """The residue of i with the highest mean value, the smallest on a tie."""
    per = df.withColumn("phase", F.pmod(F.col(i), F.lit(period))).groupBy(*keys, "phase").agg(F.avg(value).alias("mean"))
    return per.groupBy(*keys).agg(F.max_by("phase", F.struct("mean", -F.col("phase"))).alias("phase"))


def weighted_vote(df: DataFrame, keys: list[str], label: str, weight: Column) -> DataFrame:
    """The label with the most weight, the first by name on a tie, and its share."""
    per = df.groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    return per.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("w"), F.col(label))).alias("winner"), (F.max("w") / F.sum("w")).alias("share"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value; the smallest on a tie."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    return per.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("c"), F.col(value))).alias("mode"), F.max("c").alias("n"))


def distinct_by_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """Items that stand in several groups, with the number of groups."""
    return df.groupBy(item).agg(F.count_distinct(group).alias("groups")).where("groups > 1")


def top_classes(df: DataFrame, keys: list[str], label: str, value: str, k: int) -> DataFrame:
    """The k labels of highest mean, ranked."""
    per = df.groupBy(*keys, label).agg(F.avg(value).alias("mean"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean"), label))).where(F.col("rank") <= k)
