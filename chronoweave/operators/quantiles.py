"""Exact quantiles by selection: no group is gathered, sorted whole or held as counts of all its values.

Approximate ranks, whose error has a bound, bracket each wanted rank; the rows below a bracket are counted and those inside it, a few
thousandths of the group, are ranked by the counts of their values. Both passes add up in the map tasks first, so a group with a third of
all rows uses all of them.

Nulls and NaN don't count; a group without values has null; of two middle values the mean by weight (linear interpolation); rows with a null key are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of approximate quantiles are right to one in so many rows.
ACCURACY = 10_000


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """keys and one double column for each of ``shares`` (name to share of the rows below, 0 to 1)."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
    names = list(shares)
    # A rank is off by n / accuracy at most; two such steps to each side are surely outside.
    margin = 2.0 / accuracy
    ends = [x for name in names for x in (max(0.0, shares[name] - margin), min(1.0, shares[name] + margin))]
    found = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_ends"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    low = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.when(F.get(F.lit(ends), 2 * k) <= 0, F.col("_least")).otherwise(F.get("_ends", 2 * k)))
    high = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.when(F.get(F.lit(ends), 2 * k + 1) >= 1, F.col("_most")).otherwise(F.get("_ends", 2 * k + 1)))
    at = F.array(*((F.col("_n") - 1) * F.lit(float(shares[name])) for name in names))
    brackets = found.select(*keys, "_n", F.arrays_zip(F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("k"), low.alias("low"), high.alias("high"), at.alias("at")).alias("_b"))
    met = equal_join(rows.where("_v is not null"), brackets, keys)
    # The rank before and the one after may be the next value outside.
    under, over = (lambda k: F.col("_v") < F.col("_b")[k]["low"]), (lambda k: F.col("_v") > F.col("_b")[k]["high"])
    below = met.groupBy(*keys).agg(
        F.array(*(F.sum(under(k).cast("long")) for k in range(len(names)))).alias("_below"), F.array(*(F.max(F.when(under(k), F.col("_v"))) for k in range(len(names)))).alias("_down"),
        F.array(*(F.min(F.when(over(k), F.col("_v"))) for k in range(len(names)))).alias("_up"),
    )
    inside = met.select(*keys, "_v", F.explode(F.filter("_b", lambda b: (F.col("_v") >= b["low"]) & (F.col("_v") <= b["high"]))).alias("b"))
    counted = inside.groupBy(*keys, F.col("b.k").alias("k"), F.col("b.at").alias("at"), "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "k").orderBy("_v"))
    ranked = equal_join(counted.withColumn("_to", upto), below, keys)
    # Of a value: the numbers, from 0, of its first and last row in the group.
    ranked = ranked.withColumn("_to", F.col("_to") + F.get("_below", F.col("k"))).withColumn("_from", F.col("_to") - F.col("_c"))
    holds = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_v")))
    next_to = lambda side: F.get(F.first(side), F.col("k"))
    picked = ranked.groupBy(*keys, "k", "at").agg(F.coalesce(holds(F.floor("at")), next_to("_down")).alias("_lo"), F.coalesce(holds(F.ceil("at")), next_to("_up")).alias("_hi"))
    part = F.col("at") - F.floor("at")
    one = picked.select(*keys, "k", F.when(part == 0, F.col("_lo")).otherwise((1 - part) * F.col("_lo") + part * F.col("_hi")).alias("_q"))
    wide = one.groupBy(*keys).agg(*(F.max(F.when(F.col("k") == k, F.col("_q"))).alias(name) for k, name in enumerate(names)))
    return equal_join(df.select(*keys).distinct(), wide, keys, "left")


def interpolated(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """keys and the exact quantile, a double, of groups that are many and small: values are ranked by a window, and the two middle ones are weighed and added with one rounding (a fused multiply-add).

    Limits that values are compared with come from here: a limit that is off in its last bit parts values from those equal to it. Nulls don't count; a group without values has no row.
    """
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.select(*keys, "_v", (F.row_number().over(w.orderBy("_v")) - 1).alias("_i"), ((F.count("*").over(w) - 1) * F.lit(float(share))).alias("_at"))
    middle = rows.where((F.col("_i") == F.floor("_at")) | (F.col("_i") == F.ceil("_at"))).groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_at").alias("_at"))
    part = F.col("_at") - F.floor("_at")
    between = F.expr("cast(java_method('java.lang.Math', 'fma', _lo, 1D - (_at - floor(_at)), _hi * (_at - floor(_at))) as double)")
    return middle.select(*keys, F.when(part == 0, F.col("_lo")).otherwise(between).alias(name))


def equal_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(renamed[f"_k{i}"])
    return left.join(renamed, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def robust(df: DataFrame, keys: list[str], value: str, factor: float = 1.4826) -> DataFrame:
    """keys, centre (median) and spread (scaled median distance from it), by two selections."""
    centre = quantiles(df, keys, value, {"centre": 0.5})
    away = equal_join(df.select(*keys, F.col(value).cast("double").alias("_x")), centre, keys).withColumn("_x", F.abs(F.col("_x") - F.col("centre")))
    return quantiles(away, [*keys, "centre"], "_x", {"spread": 0.5}).withColumn("spread", factor * F.col("spread"))
