"""Cutting speech: fillers and long pauses out of parts, the pieces that stay, and phrases snapped to silence.

Samples are (keys, i, level) at ``rate`` a second; words are (keys, ord, w, s, e) and parts (keys, part, start, end), in seconds. Each
step is a join by equal keys (silences are laid over samples by number) or a window within a part; only the
fold of overlapping cuts is a scan. A part without words, fillers or pauses stays whole; empty tables give no pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import matching, quantiles, selection, signals, tracks


@dataclass(frozen=True)
class Pauses:
    """Seconds and decibels of the cutting rules."""

    rate: int = 200
    over_floor: float = 6.0
    under_speech: float = 12.0
    silence: float = 0.04
    air: float = 0.04
    filler_rest: float = 0.2
    before: tuple[float, float, float, float] = (0.7, 0.1, 0.12, 0.15)
    after: tuple[float, float, float, float] = (0.1, 0.7, 0.15, 0.35)
    edge: tuple[float, float] = (0.06, 0.03)
    tail: tuple[float, float] = (0.03, 0.08)
    least_cut: float = 0.05
    pause: tuple[float, float] = (0.5, 0.25)
    sentence_pause: tuple[float, float] = (0.8, 0.45)
    near: float = 0.02
    shortest: float = 0.03
    piece: float = 0.25


def with_limits(parts: DataFrame, samples: DataFrame, keys: list[str], p: Pauses) -> DataFrame:
    """Parts with the level at or under which they are quiet: over the recording's floor, or well under the part's own speech if that is lower."""
    floor = quantiles.interpolated(samples, keys, "level", 0.05, "_floor")
    inside = parts.select(*keys, "part", F.explode(F.sequence((F.col("start") * p.rate).cast("long"), F.greatest((F.col("end") * p.rate).cast("long"), (F.col("start") * p.rate).cast("long") + 2) - 1)).alias("i"))
    speech = quantiles.interpolated(inside.join(samples, [*keys, "i"]), [*keys, "part"], "level", 0.9, "_speech")
    rows = parts.join(floor, keys).join(speech, [*keys, "part"])
    return rows.withColumn("quiet", F.least(F.col("_floor") + p.over_floor, F.col("_speech") - p.under_speech)).drop("_floor", "_speech")


def filler_cuts(fillers: DataFrame, samples: DataFrame, keys: list[str], p: Pauses) -> DataFrame:
    """keys, part, start, end, why: each filler with the silence around it, less what is kept of that; one with silence on neither side stays."""
    own = ["part", "ord"]

    def around(back, ahead, low, high, at: str, side: str, last: bool) -> DataFrame:
        spans = fillers.select(*keys, *own, "quiet", F.col(at).alias("_at"), (F.col(at) - back).alias("_a"), (F.col(at) + ahead).alias("_z"))
        runs = signals.silence_runs(samples, spans, keys, own, "i", "level", "_a", "_z", "quiet", p.rate, p.silence * p.rate).join(spans, [*keys, *own])
        met = F.col(side) / p.rate
        runs = runs.where((met >= F.col("_at") - low) & (met <= F.col("_at") + high))
        pick = F.struct((F.col("from") / p.rate).alias("a"), (F.col("to") / p.rate).alias("z"))
        return runs.groupBy(*keys, *own).agg((F.max_by if last else F.min_by)(pick, "from").alias("_before" if last else "_after"))

    rows = fillers.join(around(*p.before, "s", "to", True), [*keys, *own], "left").join(around(*p.after, "e", "from", False), [*keys, *own], "left")
    rows = rows.where("_before is not null or _after is not null")
    spans = rows.select(*keys, *own, (F.col("s") - p.edge[0]).alias("_a"), (F.col("s") + p.edge[1]).alias("_z"), (F.col("e") - p.tail[0]).alias("_b"), (F.col("e") + p.tail[1]).alias("_y"))
    rows = rows.join(signals.quietest(samples, spans, keys, own, "i", "level", "_a", "_z", p.rate, "_first"), [*keys, *own], "left")
    rows = rows.join(signals.quietest(samples, spans, keys, own, "i", "level", "_b", "_y", p.rate, "_last"), [*keys, *own], "left")
    keep = max(p.air, p.filler_rest / 2)
    rest = lambda run: F.least(F.lit(keep), (F.col(f"{run}.z") - F.col(f"{run}.a")) / 2)
    start = F.coalesce(F.col("_before.a") + rest("_before"), F.col("_first") / p.rate)
    end = F.coalesce(F.col("_after.z") - rest("_after"), F.col("_last") / p.rate)
    return rows.select(*keys, "part", "ord", start.alias("start"), end.alias("end"), F.lit("filler").alias("why")).where(F.col("end") > F.col("start") + p.least_cut)


def pause_cuts(words: DataFrame, samples: DataFrame, keys: list[str], sentence_end: Column, p: Pauses) -> DataFrame:
    """keys, part, start, end, why: silences between following words over the longest pause, cut in the middle down to the wanted one; after a sentence both are longer."""
    w = Window.partitionBy(*keys, "part").orderBy("ord")
    ended = F.coalesce(sentence_end, F.lit(False))
    pairs = words.select(
        *keys, "part", "ord", "quiet", F.when(ended, p.sentence_pause[0]).otherwise(p.pause[0]).alias("_most"), F.when(ended, p.sentence_pause[1]).otherwise(p.pause[1]).alias("_goal"),
        (F.col("s") + 0.5 * (F.col("e") - F.col("s"))).alias("_a"), F.lead(F.col("s") + 0.3 * (F.col("e") - F.col("s"))).over(w).alias("_z"),
    ).where("_z is not null")
    runs = signals.silence_runs(samples, pairs, keys, ["part", "ord"], "i", "level", "_a", "_z", "quiet", p.rate, 1).join(pairs, [*keys, "part", "ord"])
    length = (F.col("to") - F.col("from")) / p.rate
    rest = F.greatest(F.col("_goal"), F.lit(2 * p.air)) / 2
    long = runs.where(length > F.col("_most"))
    return long.select(*keys, "part", "ord", (F.col("from") / p.rate + rest).alias("start"), (F.col("to") / p.rate - rest).alias("end"), (F.col("from") / p.rate).alias("_r0"), (F.col("to") / p.rate).alias("_r1"), F.lit("pause").alias("why"))


def planned_cuts(words: DataFrame, samples: DataFrame, parts: DataFrame, keys: list[str], filler: Column, sentence_end: Column, width, p: Pauses | None = None) -> tuple[DataFrame, DataFrame]:
    """Cuts (keys, part, start, end, why) and pieces (keys, part, start, end, name) of parts.

    Words are those whose middle lies in a part (bounds included). Pauses that a filler's cut touches are left alone; cuts are clipped to the part
    and folded; pieces shorter than ``piece`` fall away, and the pieces of a part are named by its number and a letter.
    """
    p = p or Pauses()
    limits = with_limits(parts, samples, keys, p)
    middle = words.withColumn("_m", (F.col("s") + F.col("e")) / 2).withColumn("_filler", F.coalesce(filler, F.lit(False)))
    inside = matching.points_in_intervals(middle, limits, keys, "_m", "start", "end", width)
    fillers = filler_cuts(inside.where("_filler"), samples, keys, p)
    cut_words = fillers.select(*keys, "part", "ord")
    pauses = pause_cuts(inside.join(cut_words, [*keys, "part", "ord"], "left_anti"), samples, keys, sentence_end, p)
    own = fillers.groupBy(*keys, "part").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("z"))).alias("_cuts"))
    pauses = pauses.join(own, [*keys, "part"], "left").where(~F.exists(F.coalesce("_cuts", F.array().cast("array<struct<a:double,z:double>>")), lambda c: (c["a"] < F.col("_r1")) & (c["z"] > F.col("_r0"))))
    raw = fillers.select(*keys, "part", "start", "end", "why").unionByName(pauses.select(*keys, "part", "start", "end", "why"))
    raw = raw.join(parts.select(*keys, "part", F.col("start").alias("_p"), F.col("end").alias("_q")), [*keys, "part"]).where((F.col("end") > F.col("_p")) & (F.col("start") < F.col("_q")))
    raw = raw.select(*keys, "part", F.greatest("start", "_p").alias("start"), F.least("end", "_q").alias("end"), "why")
    cuts = selection.merged_cuts(raw, [*keys, "part"], "start", "end", "why", p.near, p.shortest)
    bounds = parts.select(*keys, "part", F.col("start").alias("_t"), F.lit(0).alias("_o")).unionByName(cuts.select(*keys, "part", F.col("end").alias("_t"), F.lit(1).alias("_o")))
    stops = cuts.select(*keys, "part", F.col("start").alias("_t")).unionByName(parts.select(*keys, "part", F.col("end").alias("_t")))
    number = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("_t")))
    pieces = number(bounds).withColumnRenamed("_t", "start").join(number(stops).withColumnRenamed("_t", "end"), [*keys, "part", "_k"])
    pieces = pieces.where(F.col("end") - F.col("start") >= p.piece).select(*keys, "part", "start", "end")
    return cuts, tracks.lettered(pieces, keys, "part", ["start"])


def snapped_phrases(found: DataFrame, samples: DataFrame, keys: list[str], phrase: str, period: float, quiet: str, rate: int, lead: float = 0.12, air: float = 0.25) -> DataFrame:
    """Source range and beats of phrases: keys, phrase, start, end, beats.

    found: keys, phrase, s (of the first word), e (of the last), next_s (of the word after it, or null) and the level under which it is quiet. A phrase begins
    in the last silence before it, ``lead`` before its end at most, and ends in the first one after it; without any, by the words' own times. The last
    beat is left off if the next word begins in it and the last word still fits.
    """

    def silence(back, ahead, at: str, least: float) -> DataFrame:
        spans = found.select(*keys, phrase, quiet, F.greatest(F.lit(0.0), F.col(at) - back).alias("_a"), (F.col(at) + ahead).alias("_z"))
        runs = signals.silence_runs(samples, spans, keys, phrase, "i", "level", "_a", "_z", quiet, rate, least * rate)
        return runs.join(found.select(*keys, phrase, F.col(at).alias("_at")), [*keys, phrase]).select(*keys, phrase, "_at", (F.col("from") / rate).alias("a"), (F.col("to") / rate).alias("z"))

    before = silence(0.8, 0.05, "s", 0.04).where(F.col("z") <= F.col("_at") + 0.1).groupBy(*keys, phrase).agg(F.max_by(F.struct("a", "z"), "a").alias("_b"))
    after = silence(0.1, 1.0, "e", 0.06).groupBy(*keys, phrase).agg(F.min_by(F.struct("a", "z"), "a").alias("_f"))
    rows = found.join(before, [*keys, phrase], "left").join(after, [*keys, phrase], "left")
    begin = F.coalesce(F.greatest(F.col("_b.a") + F.least(F.lit(0.03), (F.col("_b.z") - F.col("_b.a")) / 2), F.col("_b.z") - lead), F.col("s") - lead)
    stop = F.coalesce(F.col("_f.a") + F.least(F.lit(air), (F.col("_f.z") - F.col("_f.a")) / 2), F.col("e") + 0.3)
    rows = rows.withColumn("start", F.greatest(F.lit(0.0), begin)).withColumn("end", stop)
    beats = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / period - 0.04).cast("int"))
    rows = rows.withColumn("beats", beats)
    early = (F.col("next_s") < F.col("start") + F.col("beats") * period - 0.03) & (F.col("beats") > 1) & (F.col("e") + 0.15 <= F.col("start") + (F.col("beats") - 1) * period)
    return rows.select(*keys, phrase, "start", "end", F.when(early, F.col("beats") - 1).otherwise(F.col("beats")).alias("beats"))
