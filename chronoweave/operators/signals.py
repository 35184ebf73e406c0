"""Sampled signals: silence runs, onsets, rank filters, novelty, pulses, pauses inside regions and speed curves.

A signal is rows of (key, sample number, value). Windows run within a key; sums over neighbours at fixed distances are window
frames or equi joins on shifted sample numbers, never joins by inequality. A null value is no sample: it is left out of
sums, medians and runs, and compares as false. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import quantiles


def _along(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def silence_runs(samples: DataFrame, parts: DataFrame, keys: list[str], part: str | list[str], i: str, level: str, start: str, end: str, limit, rate: int, least) -> DataFrame:
    """Runs of samples at or under ``limit`` (a number, or a column of the parts) inside each part: keys, part, from, to (sample numbers, end exclusive).

    A part covers the samples from trunc(start * rate) to trunc(end * rate), both included; runs of under ``least`` samples are left out.
    Parts are laid over the samples as equal keys, one row per sample of a part.
    """
    part = [part] if isinstance(part, str) else part
    at = F.explode(F.sequence(F.greatest(F.lit(0), (F.col(start) * rate).cast("long")), F.greatest(F.lit(0), (F.col(end) * rate).cast("long"))))
    most = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    rows = parts.where(F.col(start) <= F.col(end)).select(*keys, *part, most.alias("_most"), at.alias(i)).join(samples.select(*keys, i, level), [*keys, i]).where(F.col(level) <= F.col("_most"))
    w = Window.partitionBy(*keys, *part).orderBy(i)
    runs = rows.withColumn("_run", F.col(i) - F.row_number().over(w)).groupBy(*keys, *part, "_run").agg(F.min(i).alias("from"), (F.max(i) + 1).alias("to")).drop("_run")
    return runs.where(F.col("to") - F.col("from") >= least)


def quietest(samples: DataFrame, spans: DataFrame, keys: list[str], part: list[str], i: str, level: str, start: str, end: str, rate: int, name: str) -> DataFrame:
    """keys, part and the number of the quietest sample (the first of equal ones) from trunc(start * rate) to trunc(end * rate)."""
    at = F.explode(F.sequence(F.greatest(F.lit(0), (F.col(start) * rate).cast("long")), F.greatest(F.lit(0), (F.col(start) * rate).cast("long"), (F.col(end) * rate).cast("long"))))
    rows = spans.select(*keys, *part, at.alias(i)).join(samples.select(*keys, i, level), [*keys, i]).where(F.col(level).isNotNull())
    return rows.groupBy(*keys, *part).agg(F.min_by(i, F.struct(level, i)).alias(name))


def rank_filtered(df: DataFrame, keys: list[str], order: str, value: str, reach: int, percent: int, name: str = "ranked") -> DataFrame:
    """The value of rank floor(n * percent / 100), from 0, among the n = 2 * reach + 1 values around a row; past an end the end's own value counts again. No interpolation."""
    w = _along(keys, order)
    near, whole = w.rowsBetween(-reach, reach), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(w), F.count("*").over(whole)
    before, after = F.greatest(F.lit(0), F.lit(reach + 1) - at).cast("int"), F.greatest(F.lit(0), at + reach - n).cast("int")
    values = F.concat(F.array_repeat(F.first(value).over(whole), before), F.collect_list(value).over(near), F.array_repeat(F.last(value).over(whole), after))
    return df.withColumn(name, F.get(F.array_sort(values), F.lit((2 * reach + 1) * percent // 100)))


def onset_curve(df: DataFrame, keys: list[str], order: str, value: str, floor: float = 1e-4, reach: int = 4, name: str = "onset") -> DataFrame:
    """Sum, over ``reach`` rows on either side, of how much the logarithm of the value rises from row to row; windows are cut at the ends."""
    w = _along(keys, order)
    log = F.log(F.col(value) + floor)
    rise = F.greatest(F.lit(0.0), F.coalesce(log - F.lag(log).over(w), F.lit(0.0)))
    return df.withColumn("_rise", rise).withColumn(name, F.sum("_rise").over(w.rowsBetween(-reach, reach))).drop("_rise")


def cut_candidates(df: DataFrame, keys: list[str], order: str, diff: str, least: float = 4.0, ratio: float = 1.8) -> DataFrame:
    """Rows, but the first, whose difference is the largest of five around it, over ``least``, and ``ratio`` times the median (0 for the second row) of up to five rows that end two before it, plus a half."""
    w = _along(keys, order)
    near = F.max(diff).over(w.rowsBetween(-2, 2))
    at = F.row_number().over(w)
    # A window frame takes no median, so the few values are gathered and sorted.
    earlier = F.array_sort(F.collect_list(diff).over(w.rowsBetween(-6, -2)))
    n = F.size(earlier)
    base = F.when(at == 2, F.lit(0.0)).otherwise((F.get(earlier, F.floor((n - 1) / 2).cast("int")) + F.get(earlier, F.floor(n / 2).cast("int"))) / 2)
    rows = df.withColumn("_near", near).withColumn("_base", base).withColumn("_at", at)
    return rows.where((F.col("_at") > 1) & (F.col(diff) >= F.col("_near")) & (F.col(diff) > least) & (F.col(diff) / (F.col("_base") + 0.5) >= ratio)).drop("_near", "_base", "_at")


def split_at_pauses(samples: DataFrame, regions: DataFrame, keys: list[str], region: str, i: str, level: str, start: str, end: str, depth, least: int, percent: float = 0.8) -> DataFrame:
    """Pieces of regions (sample numbers [start, end)) between pauses: runs of ``least`` samples or more whose level is under the region's own percentile less ``depth`` and that touch neither end of it. keys, region, piece (from 0), start, end."""
    rows = regions.select(*keys, region, start, end, F.explode(F.expr(f"sequence({start}, {end} - 1)")).alias(i)).join(samples.select(*keys, i, level), [*keys, i])
    high = quantiles.interpolated(rows, [*keys, region], level, percent, "_high")
    quiet = rows.join(high, [*keys, region]).where(F.col(level) < F.col("_high") - depth)
    w = Window.partitionBy(*keys, region).orderBy(i)
    runs = quiet.withColumn("_run", F.col(i) - F.row_number().over(w)).groupBy(*keys, region, start, end, "_run").agg(F.min(i).alias("_a"), (F.max(i) + 1).alias("_b"))
    pauses = runs.where((F.col("_b") - F.col("_a") >= least) & (F.col("_a") > F.col(start)) & (F.col("_b") < F.col(end))).select(*keys, region, "_a", "_b")
    # A pause ends one piece and begins the next: its ends are bounds, and bounds are paired in order.
    bounds = regions.select(*keys, region, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("is_end")), F.struct(F.col(end).alias("at"), F.lit(1).alias("is_end")))).alias("x"))
    bounds = bounds.unionByName(pauses.select(*keys, region, F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(1).alias("is_end")), F.struct(F.col("_b").alias("at"), F.lit(0).alias("is_end")))).alias("x")))
    w = Window.partitionBy(*keys, region).orderBy("x.at", "x.is_end")
    paired = bounds.withColumn("_to", F.lead("x.at").over(w)).where("x.is_end = 0")
    return paired.select(*keys, region, (F.row_number().over(w) - 1).alias("piece"), F.col("x.at").alias(start), F.col("_to").alias(end))


def refined_bounds(samples: DataFrame, turns: DataFrame, keys: list[str], number: str, i: str, level: str, start: str, end: str, label: str, radius: int, margin: int) -> DataFrame:
    """Turns (sample numbers) with touching turns of different labels meeting at the quietest sample within ``radius`` of their bound, ``margin`` away from their far ends; the first of equal levels.

    Each bound is judged by the turns as they come in.
    """
    w = Window.partitionBy(*keys).orderBy(number)
    nxt = turns.withColumn("_start", F.lead(start).over(w)).withColumn("_end", F.lead(end).over(w)).withColumn("_label", F.lead(label).over(w))
    bound = nxt.where((F.col("_start") == F.col(end)) & (F.col("_label") != F.col(label)))
    low, high = F.greatest(F.col(end) - radius, F.col(start) + margin), F.least(F.col(end) + radius, F.col("_end") - margin)
    at = bound.withColumn("_lo", low).withColumn("_hi", high).where("_hi > _lo").select(*keys, number, F.explode(F.sequence("_lo", "_hi")).alias(i))
    best = at.join(samples.select(*keys, i, level), [*keys, i]).where(F.col(level).isNotNull()).groupBy(*keys, number).agg(F.min_by(i, F.struct(level, i)).alias("_new"))
    moved = turns.join(best, [*keys, number], "left")
    return moved.withColumn(start, F.coalesce(F.lag("_new").over(w), F.col(start))).withColumn(end, F.coalesce("_new", F.col(end))).drop("_new")


def novelty(df: DataFrame, keys: list[str], i: str, vector: str, reach: int, name: str = "novelty") -> DataFrame:
    """Checkerboard novelty of a sequence of vectors: likeness inside the ``reach`` rows before and inside the ``reach`` rows from a row on, less likeness across, not under 0; keys, i and the novelty, 0 where the board isn't whole.

    The board's sum of products is the squared length of the difference between the sums of both halves, so no
    matrix of likenesses is made: vectors are summed per component along the rows.
    """
    parts = df.select(*keys, i, F.posexplode(vector).alias("_d", "_v"))
    w = Window.partitionBy(*keys, "_d").orderBy(i)
    after, before = F.sum("_v").over(w.rowsBetween(0, reach - 1)), F.sum("_v").over(w.rowsBetween(-reach, -1))
    at, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys, "_d"))
    whole = (at > reach) & (at + reach <= n)
    rows = parts.select(*keys, i, F.when(whole, (after - before) * (after - before)).otherwise(F.lit(0.0)).alias("_s"))
    return rows.groupBy(*keys, i).agg(F.greatest(F.lit(0.0), F.sum("_s")).alias(name))


def local_pulse(df: DataFrame, keys: list[str], i: str, value: str, block: int, low: int, high: int) -> DataFrame:
    """Per block of samples, the lag from ``low`` to ``high`` with the largest mean product of samples that far apart (the smallest on a tie): keys, block, lag, strength.

    Each sample meets the few at those lags through equal sample numbers.
    """
    rows = df.select(*keys, i, F.col(value).alias("_x"), F.floor(F.col(i) / block).cast("long").alias("block"))
    ahead = rows.select(*keys, F.col(i).alias("_j"), F.col("_x").alias("_y"), F.col("block").alias("_b"))
    lagged = rows.withColumn("lag", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("_j", F.col(i) + F.col("lag"))
    pairs = lagged.join(ahead, [*keys, "_j"]).where("block = _b")
    per = pairs.groupBy(*keys, "block", "lag").agg(F.avg(F.col("_x") * F.col("_y")).alias("_m"))
    return per.groupBy(*keys, "block").agg(F.max_by("lag", F.struct("_m", -F.col("lag"))).alias("lag"), F.max("_m").alias("strength"))


def window_maximum(df: DataFrame, keys: list[str], i: str, value: str, length: int) -> DataFrame:
    """Per key the first row from which ``length`` values have the largest sum: keys, at, total; keys with fewer rows have none."""
    w = _along(keys, i)
    rows = df.withColumn("_s", F.sum(value).over(w.rowsBetween(0, length - 1))).withColumn("_n", F.count(value).over(w.rowsBetween(0, length - 1))).where(F.col("_n") == length)
    return rows.groupBy(*keys).agg(F.min_by(i, F.struct(-F.col("_s"), F.col(i))).alias("at"), F.max("_s").alias("total"))


def speed(mode: Column, b: Column, value: Column, freeze_at: Column) -> Column:
    """Speed at a beat of a shot by its mode; the figures are fixed values."""
    ramp = (
        F.when(b < 2, 1 + 1.2 * (b / 2) * (b / 2))
        .when(b < 2.12, 0.5 + 1.7 * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (b - 2) / 0.12)))
        .when((b < 3) | (mode == "ramp_hold"), F.lit(0.5))
        .otherwise(0.5 + 1.2 * (b - 3) * (b - 3))
    )
    return (
        F.when(mode == "fast", 1.5).when(mode == "slow", 0.5).when(mode == "speed", F.coalesce(value, F.lit(1.0)))
        .when(mode == "freeze", F.when(b < freeze_at, 1.0).otherwise(0.0)).when(mode.isin("ramp", "ramp_hold"), ramp).otherwise(F.lit(1.0))
    )


def speed_curve(shots: DataFrame, keys: list[str], mode: str, beats: str, value: str, freeze_at: str, period: float, steps: int) -> DataFrame:
    """keys, b and offset: how far into its source, in seconds, a shot is at ``steps`` + 1 even places b of its beats (trapezoids summed along the shot)."""
    # A shot's places are an array of its own row, so nothing is shuffled or sorted.
    rows = shots.select(*keys, mode, beats, value, freeze_at).withColumn("_b", F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k * F.col(beats) / steps))
    rows = rows.withColumn("_v", F.transform("_b", lambda b: speed(F.col(mode), b, F.col(value), F.col(freeze_at))))
    area = lambda k: F.coalesce((F.get("_v", k) + F.get("_v", k - 1)) / 2 * (F.get("_b", k) - F.get("_b", k - 1)), F.lit(0.0))
    sums = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.lit(0.0)), lambda some, k: F.concat(some, F.array(F.get(some, k - 1) + area(k))))
    rows = rows.select(*keys, F.explode(F.arrays_zip(F.col("_b").alias("b"), sums.alias("s"))).alias("_x"))
    return rows.select(*keys, "_x.b", (F.col("_x.s") * period).alias("offset"))


def overlap_mix(bins: DataFrame, pieces: DataFrame, keys: list[str], start: str, end: str, value: str, width) -> DataFrame:
    """Mean value of the pieces that a bin overlaps, weighted by the length they share: keys, start, end, mix; bins that overlap none have no row."""
    from chronoweave.operators.matching import overlaps

    shared = overlaps(bins, pieces, keys, start, end, width)
    return shared.groupBy(*keys, start, end).agg((F.sum(F.col("shared") * F.col(value)) / F.sum("shared")).alias("mix"))
