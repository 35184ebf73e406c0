"""Speakers of a recording from voice vectors of short windows: first groups, then rounds of a label path and new mean voices.

A round labels the windows of each region by the best path (a change of speaker has a price), keeps the speakers that talk long enough or are like no other,
and takes the mean of a speaker's windows as its voice. Whether a recording is settled is decided in the table: its windows' labels are those of
the round before. A settled recording takes no part in later rounds, as they would give the same voices again.

Vectors are of unit length and of one length in a recording; rows without one have no label. Recordings, regions and windows may be of any
number; a recording has few speakers, whose voices travel as one array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import selection, similarity
from chronoweave.operators.sections import dot
from chronoweave.sources import tables

#: Cosine distance of two speakers, price of a change, seconds a window stands for, least seconds of a speaker, cosine at which a rare one is like another, rounds.
APART, PRICE, HOP, LEAST, ALIKE, ROUNDS = 0.7, 0.3, 0.125, 1.0, 0.4, 3

_VOICES = "voices"


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def mean_voices(df: DataFrame, keys: list[str], label: str, vector: str) -> DataFrame:
    """keys and ``voices``: an array, by label, of label, the unit mean vector and the number of windows."""
    parts = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(*keys, label, F.posexplode(vector).alias("_i", "_v"))
    parts = parts.groupBy(*keys, label, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"), F.count("*").alias("_n"))
    each = parts.groupBy(*keys, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("_m"), F.max("_n").alias("_n"))
    voice = F.struct(F.col(label).cast("long").alias("label"), _unit(F.col("_m")).alias("mean"), F.col("_n").alias("n"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(voice)).alias(_VOICES))


def kept(voices: Column, least: float = LEAST, alike: float = ALIKE, hop: float = HOP) -> Column:
    """The voices to keep: those of ``least`` seconds; then the rare ones, the longest first, whose cosine to every one kept so far is under ``alike``; if none is left by that, the longest. In order of label."""
    often = F.filter(voices, lambda v: v["n"] * hop >= least)
    by_time = lambda x, y: F.when(x["n"] != y["n"], (y["n"] - x["n"]).cast("int")).otherwise((x["label"] - y["label"]).cast("int"))
    rare = F.array_sort(F.filter(voices, lambda v: (v["n"] > 0) & (v["n"] * hop < least)), by_time)
    new = lambda some, v: ~F.exists(some, lambda o: dot(o["mean"], v["mean"]) >= alike)
    return F.array_sort(F.aggregate(rare, often, lambda some, v: F.when(new(some, v), F.concat(some, F.array(v))).otherwise(some)))


def _labelled(df: DataFrame, voices: DataFrame, keys: list[str], region: str, order: str, vector: str, price: float) -> DataFrame:
    """Rows with ``label``, the place from 0 in their recording's voices, by the best path in each region."""
    scored = df.join(voices.select(*keys, F.transform(_VOICES, lambda v: v["mean"]).alias("_means")), keys)
    scored = scored.withColumn("_scores", F.transform("_means", lambda m: dot(F.col(vector), m))).drop("_means")
    return selection.label_path(scored, [*keys, region], [order], "_scores", price).drop("_scores")


def speakers(df: DataFrame, keys: list[str], region: str, order: str, vector: str, number: int | None = None, apart: float = APART, price: float = PRICE, most: int = 1500, rounds: int = ROUNDS, **rules) -> DataFrame:
    """Rows with ``speaker``, from 0 within their keys: ``order`` must tell the windows of a recording apart and runs through its regions.

    With a ``number``, that many groups are made and labelled once; else groups ``apart`` are refined for ``rounds`` rounds at most.
    """
    # Read by the groups, the first voices and the first round: made once.
    own = tables.written(df.where(F.col(vector).isNotNull()).withColumn("_x", F.col(vector).cast("array<double>")), "windows")
    first = similarity.grouped(own, keys, order, "_x", apart, most, number, means="sample")
    voices = tables.written(mean_voices(first.join(own.select(*keys, order, "_x"), [*keys, order]), keys, "cluster", "_x"), "voices")
    done: list[DataFrame] = []
    rows, before = own, None
    for turn in range(rounds if number is None else 0):
        rows = tables.written(_labelled(rows.select(*own.columns), voices, keys, region, order, "_x", price), "labels")
        if before is not None:
            moved = rows.select(*keys, order, "label").join(before.select(*keys, order, F.col("label").alias("_old")), [*keys, order]).groupBy(*keys).agg(F.max(F.col("label") != F.col("_old")).alias("_moved"))
            moved = tables.written(moved, "moved")
            settled = moved.where("not _moved").select(*keys)
            done.append(rows.join(settled, keys, "left_semi"))
            rows = tables.written(rows.join(settled, keys, "left_anti"), "unsettled")
            if rows.isEmpty():
                break
        # The labels of the next round count the voices kept, so they are compared by the voice they mean.
        names = mean_voices(rows, keys, "label", "_x").withColumn(_VOICES, kept(F.col(_VOICES), **rules))
        voices = tables.written(names, "voices")
        place = F.array_position(F.transform(_VOICES, lambda v: v["label"]), F.col("label")) - 1
        before = rows.join(voices, keys).select(*keys, order, place.alias("label"))
    else:
        done.append(_labelled(rows.select(*own.columns), voices, keys, region, order, "_x", price))
    labelled = reduce(lambda a, b: a.unionByName(b), (d.select(*df.columns, F.col("label").alias("speaker")) for d in done))
    return labelled.unionByName(df.where(F.col(vector).isNull()).withColumn("speaker", F.lit(None).cast("long")))
