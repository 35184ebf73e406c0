"""Costs, eligibility and in-points: what the selections choose by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool(clips: DataFrame, tags: DataFrame | None, clip: str = "clip") -> DataFrame:
    """The clips to choose from: with tags, the tagged clips that aren't rejects, measured or not; without, all measured clips, "action" if they move and "group" if not.

    clips: clip, length, score, motion; tags: clip, tags, chapters, moment. A clip without a measured score has 50.
    """
    measured = clips.select(clip, "length", "score", "motion", F.lit(True).alias("measured"))
    if tags is None:
        kind = F.when(F.col("motion") > 0, F.array(F.lit("action"), F.lit("continuous"))).otherwise(F.array(F.lit("group")))
        return measured.select("*", kind.alias("tags"), F.array(*map(F.lit, (1, 2, 3, 4))).alias("chapters"), F.lit(None).cast("double").alias("moment"))
    kept = tags.where(~F.col(clip).startswith("_") & ~F.coalesce(F.array_contains("tags", "reject"), F.lit(False)))
    joined = kept.select(clip, "tags", "chapters", "moment").join(measured, clip, "left")
    return joined.withColumn("measured", F.coalesce("measured", F.lit(False))).withColumn("score", F.coalesce("score", F.lit(50.0)))


def eligible(slot: Column, need: Column, length: Column, tags: Column, reserved: dict[str, list[str]]) -> Column:
    """Whether a clip may stand in a slot: long enough or of unknown length, and with none of the tags reserved for other slots."""
    ok = length.isNull() | (length >= need)
    for owner, own in reserved.items():
        ok = ok & ((slot == owner) | ~F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, own))), F.lit(False)))
    return ok


def suits(chapters: Column, wanted: Column, tags: Column, group: Column) -> Column:
    """Whether chapters overlap the wanted ones and the tags hold the whole group."""
    return F.arrays_overlap(chapters, wanted) & (F.size(F.array_except(group, tags)) == 0)


def in_point(moment: Column, peaks: Column, length: Column, need: Column, lead: Column) -> Column:
    """Struct (start, peak): the first of the moment and the peaks (by falling score, given in order) that fits into the clip with ``lead`` before it and ``need`` from there, else the first one moved to fit; without any, the middle of the clip (null if its length is unknown)."""
    all_peaks = F.concat(F.when(moment.isNotNull(), F.array(moment)).otherwise(F.array().cast("array<double>")), F.coalesce(peaks, F.array().cast("array<double>")))
    fits = F.filter(all_peaks, lambda p: (p - lead >= 0) & (length.isNull() | (p - lead + need <= length - 0.05)))
    first = F.get(all_peaks, F.lit(0))
    clamped = F.greatest(F.lit(0.0), F.least(first - lead, F.coalesce(length - need - 0.05, first - lead)))
    chosen = F.get(fits, F.lit(0))
    start = F.when(chosen.isNotNull(), chosen - lead).when(first.isNotNull(), clamped).when(length.isNotNull(), F.greatest(F.lit(0.0), length / 2 - need / 2))
    return F.struct(F.round(start, 3).alias("start"), F.round(F.coalesce(chosen, first), 3).alias("peak"))


#: Price of an action that a cut breaks, of a share beyond what may be unclean, of an unclean end, of a moment left out (which must keep ``MARGIN`` seconds from the ends) and of a second away; reward of a whole action, for two at most, and of motion, for so much at most.
CUT, UNCLEAN, UNCLEAN_END, LEFT_OUT, MARGIN, AWAY, WHOLE, WHOLES, MOTION, MOST_MOTION = 4.0, 10.0, 2.0, 6.0, 0.05, 0.05, 0.8, 2, 0.5, 1.2


def window_cost(cut: Column, unclean: Column, edges: Column, whole: Column, mean: Column, high: Column, start: Column, end: Column, moment: Column, wanted: Column, most_unclean: float = 0.15) -> Column:
    """Cost of a window: cut actions, unclean share and edges, less whole actions and motion (if both its mean and its high value are known), more where the moment lies outside and by distance from the wanted start."""
    cost = CUT * cut + UNCLEAN * F.greatest(F.lit(0.0), unclean - most_unclean) + UNCLEAN_END * edges - WHOLE * F.least(F.lit(WHOLES), whole)
    cost = cost - F.when(mean.isNotNull() & high.isNotNull(), MOTION * F.least(F.lit(MOST_MOTION), mean / F.greatest(high, F.lit(1e-6)))).otherwise(0.0)
    cost = cost + F.when(moment.isNotNull() & ~moment.between(start + MARGIN, end - MARGIN), LEFT_OUT).otherwise(0.0)
    return cost + F.coalesce(AWAY * F.abs(start - wanted), F.lit(0.0))


def fewest_beats(windows: DataFrame, keys: list[str], beats: str, now: str, cost: str, more: int = 4, limit: float = 0.5) -> DataFrame:
    """keys and the smallest number of beats, from two under the present one to ``more`` over it and not that one, whose best window costs less than ``limit``."""
    near = windows.where(F.col(beats).between(F.greatest(F.lit(1), F.col(now) - 2), F.col(now) + more) & (F.col(beats) != F.col(now)))
    best = near.groupBy(*keys, beats).agg(F.min(cost).alias("_c")).where(F.col("_c") < limit)
    return best.groupBy(*keys).agg(F.min(beats).alias(beats))


def song_windows(bars: DataFrame, keys: list[str], bar: str, energy: str, hits: str, lengths: tuple[int, ...] = (16, 8)) -> DataFrame:
    """Every window of those numbers of bars with its score, ranked: long ones first, then by score, then by place. keys, length, start, score, rank.

    A score is the mean energy over the song's, plus one and a half of the hits a bar, two more if the last bar has none.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    mean = F.avg("_e").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = bars.select(*keys, F.col(bar).alias("start"), F.col(energy).alias("_e"), F.col(hits).alias("_h")).withColumn("_mean", mean)
    windows = []
    for n in lengths:
        inside = w.rowsBetween(0, n - 1)
        score = F.avg("_e").over(inside) - F.col("_mean") + 1.5 * F.sum("_h").over(inside) / n + F.when(F.last("_h").over(inside) == 0, 2.0).otherwise(0.0)
        rows = rows.withColumn(f"_s{n}", F.when(F.count("*").over(inside) == n, F.struct(score.alias("score"))))
        windows.append(F.struct(F.lit(n).alias("length"), F.col(f"_s{n}").alias("s")))
    # All lengths come out of one sorting of the bars.
    out = rows.select(*keys, "start", F.explode(F.filter(F.array(*windows), lambda x: x["s"].isNotNull())).alias("_x")).select(*keys, "_x.length", "start", "_x.s.score")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("length") >= 16), F.desc("score"), "start", "length")
    return out.withColumn("rank", F.row_number().over(order))
