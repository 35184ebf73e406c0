"""Operators along ordered tracks: padded windows, cores of runs, look-backs, pieces, samples and scores.

Every window is keyed by the track, so a plan sorts once per track and shuffles once. Nulls in a value don't count
in sums and compare as false; empty tables give empty results; ties in the order are resolved by what is listed after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import quantiles


def _along(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def padded_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, reach: int, out: str = "total") -> DataFrame:
    """Sum over ``reach`` rows on either side; past an end the end's own value counts again, so each sum has 2 * reach + 1 terms."""
    w = _along(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near, at, n = w.rowsBetween(-reach, reach), F.row_number().over(w), F.count("*").over(whole)
    before, after = F.greatest(F.lit(0), F.lit(reach + 1) - at), F.greatest(F.lit(0), at + reach - n)
    return df.withColumn(out, F.sum(value).over(near) + before * F.first(value).over(whole) + after * F.last(value).over(whole))


def level_db(df: DataFrame, keys: list[str], order: list[str], value: Column, reach: int, out: str = "db") -> DataFrame:
    """Mean power of a window that is cut off at the ends, in decibels; null where the power is not above zero."""
    power = F.avg((value * value).cast("double")).over(_along(keys, order).rowsBetween(-reach, reach))
    return df.withColumn(out, F.when(power > 0, 10 * F.log10(power)))


def run_cores(df: DataFrame, keys: list[str], time: str, value: str, threshold: float, share: float) -> DataFrame:
    """Per run of values over the threshold: its ends, its first peak, and the ends of the part at or over ``share`` of the peak."""
    w = Window.partitionBy(*keys).orderBy(time)
    over = F.coalesce(F.col(value) > threshold, F.lit(False))
    run = df.withColumn("_over", over).withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_over").orderBy(time)))
    run = run.where("_over").withColumn("_peak", F.max(value).over(Window.partitionBy(*keys, "_over", "_run")))
    core = F.col(value) >= share * F.col("_peak")
    out = run.groupBy(*keys, "_over", "_run").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.min(F.when(F.col(value) == F.col("_peak"), F.col(time))).alias("peak_at"),
        F.min(F.when(core, F.col(time))).alias("core_start"), F.max(F.when(core, F.col(time))).alias("core_end"),
    )
    return out.drop("_over", "_run")


def earlier_match(df: DataFrame, keys: list[str], like: list[str], number: str, far: int, near: int, out: str = "match") -> DataFrame:
    """Smallest number among rows of the track that agree in ``like`` and stand ``near`` to ``far`` numbers before; no join is made."""
    return df.withColumn(out, F.min(number).over(Window.partitionBy(*keys, *like).orderBy(number).rangeBetween(-far, -near)))


def decayed(df: DataFrame, keys: list[str], time: str, event: Column, tau: float, out: str = "glow") -> DataFrame:
    """exp(-age / tau) of the latest event at or before a row (the largest over all past ones); 0 before the first."""
    last = F.max(F.when(event, F.col(time))).over(Window.partitionBy(*keys).orderBy(time))
    return df.withColumn(out, F.coalesce(F.exp((last - F.col(time)) / tau), F.lit(0.0)))


def shortened_gaps(df: DataFrame, keys: list[str], start: str, end: str, limit: int, target: int) -> DataFrame:
    """Pauses over ``limit`` between intervals that follow each other, and the cut in their middle that leaves ``target``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    gap = df.select(*keys, F.col(end).alias("gap_start"), F.lead(start).over(w).alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") > limit)
    cut = gap.withColumn("cut_start", F.col("gap_start") + F.lit(target // 2).cast("long"))
    return cut.withColumn("cut_end", F.col("gap_end") - F.lit(target - target // 2).cast("long"))


def lettered(df: DataFrame, keys: list[str], part: str, order: list[str], out: str = "name") -> DataFrame:
    """Names of the pieces of a part: its number alone if it has one piece, else with a, b, c and on (aa after z)."""
    w = Window.partitionBy(*keys, part)
    k = F.row_number().over(w.orderBy(*order)) - 1
    letter = lambda n: F.expr("substring('abcdefghijklmnopqrstuvwxyz', {0}, 1)".format(n))
    return (
        df.withColumn("_k", k).withColumn("_n", F.count("*").over(w))
        .withColumn(out, F.concat(F.col(part).cast("string"), F.when(F.col("_n") == 1, "").when(F.col("_k") < 26, letter("_k + 1")).otherwise(F.concat(letter("int(_k / 26)"), letter("_k % 26 + 1")))))
        .drop("_k", "_n")
    )


def samples(df: DataFrame, keep: list[str], start: str, end: str, parts: int = 3) -> DataFrame:
    """Times at the start, the end and the inner bounds of ``parts`` equal parts of an interval, numbered from 0."""
    length = F.col(end) - F.col(start)
    at = [F.col(start) + F.floor(length * k / parts).cast("long") if k < parts else F.col(end) for k in range(parts + 1)]
    return df.select(*keep, F.posexplode(F.array(*at)).alias("number", "at"))


def standardised(df: DataFrame, keys: list[str], value: Column, out: str = "z") -> DataFrame:
    """Distance from the mean of the key in standard deviations of it (0 where all values are equal); statistics are aggregated, then joined."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return df.join(stats, keys).withColumn(out, F.when(F.col("_sd") > 0, (value - F.col("_mean")) / F.col("_sd")).otherwise(F.when(value.isNotNull(), 0.0))).drop("_mean", "_sd")


def scored(df: DataFrame, penalties: dict[str, tuple[Column, float]], out: str = "score") -> DataFrame:
    """100 times the factors of all penalties that apply, and the names of those, comma-joined, in the order given."""
    factor = F.lit(100.0)
    for when, times in penalties.values():
        factor = factor * F.when(when, times).otherwise(1.0)
    return df.withColumn(out, factor).withColumn("flags", F.concat_ws(",", *(F.when(when, F.lit(name)) for name, (when, _) in penalties.items())))


#: Movement of a good sample, sharpness that is enough, shaking and camera movement that take a good part away.
MOVEMENT, SHARP, SHAKING, PANNING = 120.0, 500.0, 80.0, 500.0


def sample_quality(motion: Column, sharp: Column, luma: Column, bright: Column, dark: Column, shake: Column, camera: Column | None = None) -> Column:
    """Quality of a sample, from 0 to 1: the product of terms for movement of the subject, sharpness, exposure (mean brightness and the shares burnt out and black), shaking and, if given, the camera's movement, each within its bounds (fixed values)."""
    clip = lambda x, low: F.greatest(F.lit(low), F.least(F.lit(1.0), x))
    over = lambda x, limit: F.greatest(F.lit(0.0), x - limit)
    exposure = clip(1.0 - F.greatest(F.lit(0.0), 45 - luma) / 45 - over(luma, 215) / 40 - over(bright, 0.15) - over(dark, 0.35), 0.2)
    out = (1.0 - F.exp(-motion / MOVEMENT)) * clip(sharp / SHARP, 0.35) * exposure * F.exp(-shake / SHAKING)
    return out if camera is None else out / (1.0 + camera / PANNING)


def reel_report(shots: DataFrame, keys: list[str], scene: str, beats: str, seconds: str, jump: str, away: str, order: str, near: float = 45.0) -> DataFrame:
    """keys, shots, scenes, jumps, median beats and seconds of a shot, median beats of a scene, and how many shots after the first begin within ``near`` (fixed value, milliseconds) of a beat. Scenes without a number are one scene; null flags are false."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = shots.withColumn("_first", F.row_number().over(w) == 1)
    close = ~F.col("_first") & (F.abs(F.col(away)) <= near)
    plain = rows.groupBy(*keys).agg(F.count("*").alias("shots"), F.sum(F.coalesce(F.col(jump), F.lit(False)).cast("long")).alias("jumps"), F.sum(F.coalesce(close, F.lit(False)).cast("long")).alias("on_beat"))
    per = shots.groupBy(*keys, scene).agg(F.sum(beats).alias("_b"))
    scenes = per.groupBy(*keys).agg(F.count("*").alias("scenes"))
    out = plain.join(scenes, keys)
    for df, column, name in ((shots, beats, "shot_beats"), (shots, seconds, "shot_seconds"), (per, "_b", "scene_beats")):
        out = out.join(quantiles.quantiles(df, keys, column, {name: 0.5}), keys)
    return out
