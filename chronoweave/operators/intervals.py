"""Interval algebra and runs as window expressions, always within a key.

Times are numbers (longs or doubles). A run of true samples, a merged interval and a gap are rows. Ties in time are put
in order by ``ord``. Nulls: a null flag is false; rows with a null key or time form groups of their own and are kept
out of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def run_ids(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "run") -> DataFrame:
    """Number of the run of equal consecutive values, from 1."""
    w = _ordered(keys, *order)
    return df.withColumn("_v", value).withColumn("_n", (~F.col("_v").eqNullSafe(F.lag("_v").over(w)) | (F.row_number().over(w) == 1)).cast("int")).withColumn(name, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_v", "_n")


def merge(df: DataFrame, keys: list[str], start: str, end: str, gap, closed: bool = True, eps: float = 0, aggs: tuple[Column, ...] = ()) -> DataFrame:
    """Intervals joined where the next starts at most ``gap`` after the furthest end so far (less than ``gap - eps`` if not closed)."""
    w = _ordered(keys, start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    distance = F.col(start) - reach
    new = F.when(reach.isNull() | ((distance > gap) if closed else (distance >= gap - eps)), 1).otherwise(0)
    numbered = df.withColumn("_new", new).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *aggs).drop("_group")


def islands(df: DataFrame, keys: list[str], t: str, flag: Column, width=0, gap=0, at_least=0, eps: float = 0) -> DataFrame:
    """Runs of true samples: sample t covers [t, t + width]; gaps under ``gap - eps`` are closed, runs under ``at_least - eps`` dropped.

    Columns: keys, start, end, n (samples). Runs are numbered over all samples of a key, true or not, in one sort; only runs are aggregated.
    """
    numbered = run_ids(df, keys, [t], F.coalesce(flag, F.lit(False)))
    runs = numbered.where(flag).groupBy(*keys, "run").agg(F.min(t).alias("start"), (F.max(t) + width).alias("end"), F.count("*").alias("samples"))
    joined = merge(runs.drop("run"), keys, "start", "end", gap, closed=False, eps=eps, aggs=(F.sum("samples").alias("samples"),)).drop("n").withColumnRenamed("samples", "n")
    return joined.where(F.col("end") - F.col("start") >= at_least - eps)


def closed_runs(df: DataFrame, keys: list[str], order: str, flag: Column, bridge: int, at_least: int) -> DataFrame:
    """Runs by sample count: false stretches of up to ``bridge`` samples inside are bridged; keys, first, last (sample numbers), n."""
    w = _ordered(keys, order)
    rows = df.withColumn("_i", F.row_number().over(w)).where(flag)
    step = F.col("_i") - F.lag("_i").over(_ordered(keys, "_i"))
    grouped = rows.withColumn("_g", F.sum(F.when(step.isNull() | (step > bridge + 1), 1).otherwise(0)).over(_ordered(keys, "_i").rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min("_i").alias("first"), F.max("_i").alias("last")).drop("_g").withColumn("n", F.col("last") - F.col("first") + 1).where(F.col("n") >= at_least)


def complement(df: DataFrame, keys: list[str], start: str, end: str, low: Column, high: Column, at_least=0) -> DataFrame:
    """What disjoint intervals leave of [low, high] (expressions of the key's rows, aggregated): keys, gap_start, gap_end."""
    w = _ordered(keys, start)
    inner = df.select(*keys, F.col(end).alias("gap_start"), F.lead(start).over(w).alias("gap_end")).where("gap_end is not null")
    edges = df.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"), F.min(start).alias("_s"), F.max(end).alias("_e"))
    edge = edges.select(*keys, F.explode(F.array(F.struct(F.col("_low").alias("a"), F.col("_s").alias("b")), F.struct(F.col("_e").alias("a"), F.col("_high").alias("b")))).alias("x")).select(*keys, F.col("x.a").alias("gap_start"), F.col("x.b").alias("gap_end"))
    return inner.unionByName(edge).where((F.col("gap_end") > F.col("gap_start")) & (F.col("gap_end") - F.col("gap_start") >= at_least))


def hysteresis(df: DataFrame, keys: list[str], order: list[str], value: str, on, off, name: str = "active") -> DataFrame:
    """On above ``on``, off at or below ``off``, else as before; off at first. Needs on >= off."""
    w = _ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col(value) > on, True).when(F.col(value) <= off, False)
    return df.withColumn(name, F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(False)))


def dilate(df: DataFrame, keys: list[str], order: list[str], flag: Column, n: int, name: str = "dilated") -> DataFrame:
    return df.withColumn(name, F.max(F.coalesce(flag, F.lit(False))).over(_ordered(keys, *order).rowsBetween(-n, n)))


def isolated_jumps(df: DataFrame, keys: list[str], order: list[str], value: str, floor, near: int = 3, share: float = 0.5, name: str = "jump") -> DataFrame:
    """Values over ``floor`` whose neighbours up to ``near`` rows away are all under ``share`` of them."""
    w = _ordered(keys, *order)
    before, after = (F.coalesce(F.max(value).over(w.rowsBetween(*r)), F.lit(float("-inf"))) for r in ((-near, -1), (1, near)))
    return df.withColumn(name, (F.col(value) > floor) & (before < share * F.col(value)) & (after < share * F.col(value)))


def peaks(df: DataFrame, keys: list[str], order: list[str], value: str, height) -> DataFrame:
    """Rows above both neighbours (a plateau's first row) and at least ``height``."""
    w = _ordered(keys, *order)
    return df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w)).where((F.col(value) >= height) & (F.col(value) > F.col("_p")) & (F.col(value) >= F.col("_n"))).drop("_p", "_n")


def spaced_peaks(df: DataFrame, keys: list[str], t: str, value: str, height, distance) -> DataFrame:
    """keys, t and value of the ``peaks`` that are left when, from the highest down, each takes away those less than ``distance`` from it; of equal heights the earlier comes first. What was kept is looked up by place, so a key of any length is read once."""
    from chronoweave.operators import selection

    def step(kept: dict | None, at, _):
        kept = kept if kept is not None else {}
        cell = int(at // distance)
        free = all(abs(at - kept[c]) >= distance for c in (cell - 1, cell, cell + 1) if c in kept)
        if free:
            kept[cell] = at
        return kept, (free,)

    found = peaks(df.select(*keys, t, value), keys, [t], value, height)
    return selection.scan(found, keys, [F.desc(value), F.col(t)], [t, value], "kept boolean", step).where("kept").drop("kept")


#: Score of a frame that may be in a transition, frames bridged, frames around a run in which its cut is looked for, least frames of a blend, what its shares may fall back, its rest, and where it begins and ends; the leap of brightness of a flash and what must come back.
HOT, BRIDGE, AROUND, BLEND, FALL, REST, BEGINS, ENDS, LEAP, BACK = 0.5, 2, 2, 3, 0.15, 0.6, 0.6, 0.4, 0.1, 0.5


def transitions(df: DataFrame, keys: list[str], i: str) -> DataFrame:
    """keys, first, last, peak, score and label (blend, cut or flash) of each transition of numbered frames.

    Frames have: single and many (scores), change (to the frame before), luma, share (of the new picture in the mixture, null if unknown), rest (of the mixture that shares don't explain) and back
    (difference of the picture five frames on and the one before). A run of hot frames bridges two cold ones at most. It is a blend if it has ``BLEND`` frames and shares that rise from
    the old to the new picture, with its highest score as its peak; else a cut at the largest change near it; and a flash if brightness leaps up at the peak and the picture before comes back. Of equal values the earlier frame is taken.
    """
    from chronoweave.operators import matching

    w = Window.partitionBy(*keys).orderBy(i)
    end = F.max(i).over(Window.partitionBy(*keys))
    frames = df.withColumn("_before", F.lag("luma").over(w)).withColumn("_end", end)
    hot = F.coalesce((F.col("many") > HOT) | (F.col("single") > HOT), F.lit(False))
    gap = F.col(i) - F.lag(i).over(w)
    # Cold frames are bridged only where a whole bridge and a frame fit before the end.
    anew = (gap > BRIDGE + 1) | ((gap > 1) & (F.lag(i).over(w) + BRIDGE + 1 > F.col("_end")))
    runs = frames.where(hot).withColumn("_new", F.coalesce(anew.cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.min(i).alias("first"), F.max(i).alias("last"))
    spans = runs.select(*keys, "first", "last", (F.col("first") - AROUND).alias("_a"), (F.col("last") + AROUND).alias("_z"))
    met = matching.points_in_intervals(frames, spans, keys, i, "_a", "_z", 64)
    own = F.col(i).between(F.col("first"), F.col("last"))
    frame = F.struct(F.col(i).alias("i"), "single", "change", "luma", F.col("_before").alias("before"), "back", F.col("_end").alias("end"))
    top = lambda column, inside: F.max_by(frame, F.when(inside & F.col(column).isNotNull(), F.struct(F.col(column), -F.col(i))))
    shares = F.transform(F.array_sort(F.collect_list(F.when(own & F.col("share").isNotNull(), F.struct(i, "share")))), lambda x: x["share"])
    got = met.groupBy(*keys, "first", "last").agg(top("single", own).alias("_s"), top("change", F.col(i) >= 1).alias("_c"), shares.alias("_shares"), F.max(F.when(own, F.col("rest"))).alias("_rest"))
    falls = F.exists(F.zip_with(F.slice("_shares", 2, F.greatest(F.size("_shares") - 1, F.lit(0))), "_shares", lambda x, y: x - y), lambda d: F.coalesce(d <= -FALL, F.lit(False)))
    long = (F.col("last") - F.col("first") + 1 >= BLEND) & (F.size("_shares") > 2)
    blend = F.coalesce(long & ~falls & (F.col("_rest") < REST) & (F.get("_shares", F.lit(0)) < BEGINS) & (F.get("_shares", F.size("_shares") - 1) > ENDS), F.lit(False))
    out = got.withColumn("_blend", blend).withColumn("_p", F.when(F.col("_blend"), F.col("_s")).otherwise(F.col("_c")))
    flash = (F.col("_p.i") >= 1) & (F.col("_p.i") + 5 <= F.col("_p.end")) & (F.col("_p.luma") - F.col("_p.before") > LEAP) & (F.col("_p.back") < BACK * F.greatest(F.col("_p.change"), F.lit(1e-3)))
    label = F.when(F.coalesce(flash, F.lit(False)), "flash").when(F.col("_blend"), "blend").otherwise("cut")
    return out.select(*keys, "first", "last", F.col("_p.i").alias("peak"), F.col("_s.single").alias("score"), label.alias("label"))


def numbered_scenes(df: DataFrame, keys: list[str], order: list[str], jump: Column, name: str = "scene") -> DataFrame:
    """Counts up at every row that is no jump."""
    return df.withColumn(name, F.sum(F.when(F.coalesce(jump, F.lit(False)), 0).otherwise(1)).over(_ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)))


def running_start(df: DataFrame, keys: list[str], order: list[str], length: str, name: str = "start") -> DataFrame:
    """Sum of the lengths before a row."""
    return df.withColumn(name, F.coalesce(F.sum(length).over(_ordered(keys, *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def first_appearance(df: DataFrame, keys: list[str], label: str, t: str, name: str = "rank") -> DataFrame:
    """Labels of a key numbered by first appearance, then by name."""
    firsts = df.groupBy(*keys, label).agg(F.min(t).alias("first"))
    return firsts.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("first", label)))


def dense_axis(df: DataFrame, keys: list[str], at: str, value: str, low: str, high: str, default) -> DataFrame:
    """Every whole number of [low, high] of a key (from its rows), with the value of that place or the default."""
    axis = df.groupBy(*keys).agg(F.min(low).alias("_a"), F.max(high).alias("_b")).select(*keys, F.explode(F.expr("sequence(_a, _b)")).alias(at))
    return axis.join(df.select(*keys, at, value), [*keys, at], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def self_overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended."""
    w = _ordered(keys, start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_r", F.max(end).over(w)).where(F.col(start) < F.col("_r")).drop("_r")


def interpolate(points: DataFrame, targets: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Linear interpolation of irregular points at target times, clamped at the ends: keys, t, value."""
    both = points.select(*keys, t, F.col(value).cast("double").alias("_v"), F.lit(False).alias("_target")).unionByName(targets.select(*keys, t, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_target")))
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    w = Window.partitionBy(*keys).orderBy(t)
    both = both.withColumn("_p", F.last(point, True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(point, True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    lerp = F.expr(f"_p.v + (_n.v - _p.v) * ({t} - _p.t) / (_n.t - _p.t)")
    return both.where("_target").select(*keys, t, F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull() | (F.col("_n.t") == F.col("_p.t")), F.col("_p.v")).otherwise(lerp).alias(value))
