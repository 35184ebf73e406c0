"""Alignment of recordings: votes, confidences and plans held against what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import matching


def vote_offset(events: DataFrame, reference: DataFrame, keys: list[str], t: str, ord_: str, tolerance, first: int = 6) -> DataFrame:
    """The offset, among those of the first events to every reference time, at which most events fall within less than ``tolerance`` of one: keys, offset, hits.

    On a tie the earliest event's offset, then the smallest. An event falls near a reference time if their own distance is near the offset, so the votes
    are the events in a range of distances in order: only events and reference times are shuffled, and no event is moved by every offset.
    """
    own, marks = events.select(*keys, F.col(ord_).alias("_a"), F.col(t).alias("_t")), reference.select(*keys, F.col(t).alias("_r"))
    away = own.hint("merge").join(marks, keys).select(*keys, "_a", (F.col("_r") - F.col("_t")).alias("offset"))
    near = F.expr(f"collect_list(struct(_a, offset)) over (partition by {', '.join(f'`{k}`' for k in keys)} order by offset range between {tolerance} preceding and {tolerance} following)")
    # The range holds both its ends, which are not near.
    voted = away.withColumn("_near", near).where(F.col("_a") < first)
    voters = F.array_distinct(F.transform(F.filter("_near", lambda x: F.abs(x["offset"] - F.col("offset")) < tolerance), lambda x: x["_a"]))
    counted = voted.select(*keys, "_a", "offset", F.size(F.array_compact(voters)).cast("long").alias("hits")).where("hits > 0")
    best = counted.groupBy(*keys).agg(F.min_by(F.struct("offset", "hits"), F.struct(-F.col("hits"), F.col("_a"), F.col("offset"))).alias("b"))
    return best.select(*keys, "b.offset", "b.hits")


def confidence(first: Column, second: Column, centre: Column, spread: Column, full_ratio: float = 2.0, least: float = 10.0, full: float = 30.0) -> Column:
    """Confidence from 0 to 1 of a peak: the smaller of how far it stands over the second peak (from even to ``full_ratio`` times) and over the noise (from ``least`` to ``full`` spreads)."""
    over, other = first - centre, F.coalesce(second - centre, F.lit(0.0))
    ratio = F.when(other > 0, F.least(F.lit(99.0), over / other)).otherwise(99.0)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.least(clip((ratio - 1) / (full_ratio - 1)), clip((over / spread - least) / (full - least)))


def compared_cuts(plan: DataFrame, cuts: DataFrame, transitions: DataFrame, keys: list[str], t: str, width, tolerance: int = 2) -> DataFrame:
    """Planned times as "matched" (with the distance of the nearest cut), "in_transition" or "missing", and cuts that no planned time is near as "extra": keys, t, state, away."""
    near = matching.nearest(plan.select(*keys, t), cuts.select(*keys, t).distinct(), keys, t, [], tolerance).withColumn("away", F.col("match.t") - F.col(t))
    found = near.where("away is not null").select(*keys, t, F.lit("matched").alias("state"), "away")
    rest = near.where("away is null").select(*keys, t)
    spans = transitions.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_z"))
    inside = matching.points_in_intervals(rest, spans, keys, t, "_a", "_z", width, slack=tolerance, how="left_semi").select(*keys, t, F.lit("in_transition").alias("state"))
    missing = matching.points_in_intervals(rest, spans, keys, t, "_a", "_z", width, slack=tolerance, how="left_anti").select(*keys, t, F.lit("missing").alias("state"))
    reach = plan.select(*keys, (F.col(t) - tolerance).alias("_a"), (F.col(t) + tolerance).alias("_z"))
    extra = matching.points_in_intervals(cuts.select(*keys, t), reach, keys, t, "_a", "_z", width, how="left_anti").select(*keys, t, F.lit("extra").alias("state"))
    return found.unionByName(inside.unionByName(missing).unionByName(extra), allowMissingColumns=True)
