"""Words, speaker turns and sentences: assignment, splitting and votes.

Words are rows of (keys, segment, ord, s, e). A null label is an unknown speaker. Every window runs within a segment or a
recording; overlaps go through the bucketed interval join. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import matching, selection


def assigned_words(words: DataFrame, turns: DataFrame, double_talk: DataFrame, keys: list[str], word: str, width, least_share: float = 0.4, sure_share: float = 0.7, shortest=0.05, reach=0.25) -> DataFrame:
    """keys, word, speaker ("?" if unsure) and guess (null if sure or unknown).

    words: keys, word, s, e; turns: keys, label, s, e, unsure; double_talk: keys, s, e. A word belongs to the label whose turns
    overlap it most (the first by name on a tie), if all overlap is ``least_share`` of its length at least; surely so
    with ``sure_share`` of the overlap, no unsure turn of the label among it and its middle outside double talk. A word with less
    overlap is guessed to be of the nearest turn within ``reach`` of its middle, the earliest on a tie.
    """
    per = matching.overlaps(words.select(*keys, word, "s", "e"), turns.select(*keys, "label", "unsure", "s", "e"), keys, "s", "e", width)
    per = per.groupBy(*keys, word, "s", "e", "label").agg(F.sum("shared").alias("_o"), F.max(F.coalesce("unsure", F.lit(False))).alias("_u"))
    best = per.groupBy(*keys, word, "s", "e").agg(F.sum("_o").alias("_total"), F.min_by(F.struct("label", "_o", "_u"), F.struct(-F.col("_o"), F.col("label"))).alias("_b"))
    best = best.where(F.col("_total") >= least_share * F.greatest(F.col("e") - F.col("s"), F.lit(shortest))).drop("s", "e")
    middle = (F.col("s") + F.col("e")) / 2
    mids = words.select(*keys, word, middle.alias("_m"))
    crowded = matching.points_in_intervals(mids, double_talk.select(*keys, "s", "e"), keys, "_m", "s", "e", width, how="left_semi").select(*keys, word, F.lit(True).alias("_crowded"))
    near = matching.points_in_intervals(mids, turns.select(*keys, "label", "s", "e"), keys, "_m", "s", "e", width, slack=reach)
    away = F.greatest(F.col("s") - F.col("_m"), F.col("_m") - F.col("e"), F.lit(0))
    near = near.groupBy(*keys, word).agg(F.min_by("label", F.struct(away, F.col("s"), F.col("e"), F.col("label"))).alias("_near"))
    rows = words.select(*keys, word).join(best, [*keys, word], "left").join(crowded, [*keys, word], "left").join(near, [*keys, word], "left")
    sure = (F.col("_b._o") / F.col("_total") >= sure_share) & ~F.col("_b._u") & F.col("_crowded").isNull()
    return rows.select(
        *keys, word, F.when(F.coalesce(sure, F.lit(False)), F.col("_b.label")).otherwise("?").alias("speaker"),
        F.when(F.col("_b").isNull(), F.col("_near")).when(~sure, F.col("_b.label")).alias("guess"),
    )


def split_segments(words: DataFrame, keys: list[str], order: str, s: str, e: str, speaker: str, guess: str, name: str = "piece") -> DataFrame:
    """Words with the number, from 0, of the piece of their segment (keys) they stand in.

    A sure speaker counts, else the guess; a single guess between two words of one other speaker is taken for that speaker
    (judged in order, so that a change already made counts). A segment is cut at the largest gap between a speaker's last word and the
    next speaker's first, the earliest of equal gaps.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    unsure = F.col(speaker) == "?"
    rows = words.withColumn("_eff", F.when(unsure, F.col(guess)).otherwise(F.col(speaker))).withColumn("_unsure", unsure)
    rows = rows.withColumn("_ahead", F.first("_eff", ignorenulls=True).over(future))

    def smooth(before, own, is_guess, ahead):
        if own is not None and is_guess and before is not None and before == ahead:
            own = before
        return (own if own is not None else before), (own,)

    rows = selection.scan(rows, keys, [order], ["_eff", "_unsure", "_ahead"], "_who string", smooth)
    rows = rows.withColumn("_span", F.count("_who").over(past)).withColumn("_now", F.last("_who", ignorenulls=True).over(past))
    rows = rows.withColumn("_next", F.first("_who", ignorenulls=True).over(future)).withColumn("_gap", F.lead(s).over(w) - F.col(e))
    widest = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(F.desc("_gap"), order))
    rows = rows.withColumn("_cut", ((widest == 1) & (F.col("_now") != F.col("_next"))).cast("int"))
    rows = rows.withColumn(name, F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.drop("_eff", "_unsure", "_ahead", "_who", "_span", "_now", "_next", "_gap", "_cut")


def votes_per_winner(df: DataFrame, group: list[str], label: str, weight: Column, name: str = "n") -> DataFrame:
    """How many groups each label wins by its summed weight, the first by name on a tie: label, n. Rows without a label don't vote."""
    per = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.sum(weight).alias("_w"))
    won = per.groupBy(*group).agg(F.min_by(label, F.struct(-F.col("_w"), F.col(label))).alias(label))
    return won.groupBy(label).agg(F.count("*").alias(name))


def merged_turns(turns: DataFrame, keys: list[str], label: str, start: str, end: str, margin: str, gap) -> DataFrame:
    """Following turns of one label with at most ``gap`` between them as one, with the mean of ``margin`` weighted by length: keys, label, start, end, margin."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.col(start) - F.lag(end).over(w) > gap) | (F.row_number().over(w) == 1)
    rows = turns.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.col(end) - F.col(start)
    mean = F.when(F.sum(length) > 0, F.sum(F.col(margin) * length) / F.sum(length)).otherwise(F.avg(margin))
    return rows.groupBy(*keys, label, "_g").agg(F.min(start).alias("_s"), F.max(end).alias("_e"), mean.alias(margin)).select(*keys, label, F.col("_s").alias(start), F.col("_e").alias(end), margin)


def event_spans(scores: DataFrame, keys: list[str], i: str, group: str, value: str, thresholds: dict[str, float], weights: dict[str, float], disturbing: dict[str, float], bar: str = "quiet") -> DataFrame:
    """Spans of following windows in which a weighted group reaches its threshold: keys, first, last, label, score, disturbed.

    scores: keys, window number, group, value, and whether the window is quiet. A group's norm is its value over its threshold; a span's label is
    the group with the largest min(norm peak, 3) times weight, and its score is that, times the factor of each disturbing group that reaches
    its threshold in over half of the span's windows.
    """
    limit = F.coalesce(*(F.when(F.col(group) == g, F.lit(t)) for g, t in thresholds.items()))
    weight = F.coalesce(*(F.when(F.col(group) == g, F.lit(x)) for g, x in weights.items()))
    rows = scores.withColumn("_norm", F.col(value) / limit).where(~F.coalesce(F.col(bar), F.lit(False)) & F.col("_norm").isNotNull())
    hit = rows.where(weight.isNotNull() & (F.col("_norm") >= 1)).select(*keys, i).distinct()
    w = Window.partitionBy(*keys).orderBy(i)
    spans = hit.withColumn("_run", F.col(i) - F.row_number().over(w))
    inside = rows.join(spans, [*keys, i])
    per = inside.groupBy(*keys, "_run", group).agg(F.max("_norm").alias("_peak"), F.sum((F.col("_norm") >= 1).cast("int")).alias("_over"))
    value_of = F.when(F.col("_peak") >= 1, F.least(F.col("_peak"), F.lit(3.0)) * weight)
    factor = F.coalesce(*(F.when(F.col(group) == g, F.lit(x)) for g, x in disturbing.items()), F.lit(1.0))
    length = spans.groupBy(*keys, "_run").agg(F.min(i).alias("first"), F.max(i).alias("last"), F.count("*").alias("_n"))
    per = per.join(length, [*keys, "_run"])
    bad = (factor != 1.0) & (F.col("_over") > 0.5 * F.col("_n"))
    best = per.groupBy(*keys, "first", "last").agg(
        F.max_by(group, F.struct(F.coalesce(value_of, F.lit(-1.0)), F.col(group))).alias("label"), F.max(value_of).alias("_score"),
        F.product(F.when(bad, factor).otherwise(1.0)).alias("_factor"), F.array_sort(F.collect_set(F.when(bad, F.col(group)))).alias("_bad"),
    )
    return best.select(*keys, "first", "last", "label", (F.col("_score") * F.col("_factor")).alias("score"), F.array_join("_bad", ",").alias("disturbed"))
