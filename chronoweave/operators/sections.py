"""Sections of a piece, from one unit vector a bar: bounds where the music changes, groups of sections that repeat, and a name for each.

The change at a bar is the sum of a checkerboard over the similarities around it; for inner products that is the squared
length of (sum of the next bars' vectors less sum of the bars' before), so a window of ``reach`` bars to each side is all it needs.
Bars are numbered from 0 without gaps within their keys, vectors are of one length and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators import selection

#: Bars to each side of a bound, bars of a phrase, share of the largest change that a bound needs, and similarity of a repetition.
REACH, PHRASE, SHARE, ALIKE = 4, 4, 0.30, 0.90
#: How much louder than a hook the loudest section may be, how much softer a break is, beats a bar below which nothing plays, and the most bars of a break or an outro.
HOOK_BELOW, BREAK_BELOW, SILENT, SHORT = 4.0, 2.5, 0.3, 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def novelty(df: DataFrame, keys: list[str], bar: str, vector: str, reach: int = REACH, name: str = "novelty") -> DataFrame:
    """Rows with the change at each bar; 0 where fewer than ``reach`` bars lie before it or ``reach`` + 1 from it on."""
    w = Window.partitionBy(*keys).orderBy(bar)
    near = F.collect_list(vector).over(w.rowsBetween(-reach, reach - 1))
    rest = F.count("*").over(Window.partitionBy(*keys))
    total = lambda vs: F.aggregate(F.slice(vs, 2, reach - 1), F.element_at(vs, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    out = df.withColumn("_near", near).withColumn("_n", rest)
    change = F.zip_with(total(F.slice("_near", reach + 1, reach)), total(F.slice("_near", 1, reach)), lambda x, y: x - y)
    inside = (F.col(bar) >= reach) & (F.col(bar) < F.col("_n") - reach)
    return out.withColumn(name, F.when(inside, F.aggregate(change, F.lit(0.0), lambda s, x: s + x * x)).otherwise(0.0)).drop("_near", "_n")


def bounded(df: DataFrame, keys: list[str], bar: str, vector: str, reach: int = REACH, phrase: int = PHRASE, share: float = SHARE) -> DataFrame:
    """Rows with ``section``, numbered from 0: one begins at bar 0, and at every bar of the phrases' place whose change is at least ``share`` of the largest there. The place is the bar's remainder by ``phrase`` with the largest sum of changes, the smallest on a tie."""
    rows = novelty(df, keys, bar, vector, reach)
    per = rows.groupBy(*keys, F.pmod(F.col(bar), F.lit(phrase)).alias("_r")).agg(F.sum("novelty").alias("_s"), F.max(F.when(F.col(bar) > 0, F.col("novelty"))).alias("_top"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct(F.col("_r"), F.coalesce("_top", F.lit(1.0)).alias("_top")), F.struct("_s", -F.col("_r"))).alias("_best"))
    begins = (F.col(bar) == 0) | ((F.pmod(F.col(bar), F.lit(phrase)) == F.col("_best._r")) & (F.col("novelty") >= share * F.greatest(F.col("_best._top"), F.lit(1e-9))))
    w = Window.partitionBy(*keys).orderBy(bar)
    return rows.join(best, keys).withColumn("section", F.sum(begins.cast("long")).over(w) - 1).drop("_best", "novelty")


def repeated(rows: DataFrame, keys: list[str], bar: str, vector: str, alike: float = ALIKE) -> DataFrame:
    """keys, section, grp and repetition: a section is of the group of the first section, in order, that founded one and is ``alike`` it, else it founds the next. Likeness is the mean inner product of bars at the same place, as far as the shorter section goes; ``repetition`` is the largest to any other section, 0 without one.

    Pairs of a piece's sections are compared, as each is asked for its most alike; bars meet by their place in the section.
    """
    w = Window.partitionBy(*keys, "section")
    placed = rows.select(*keys, "section", F.col(vector).alias("_v"), (F.col(bar) - F.min(bar).over(w)).alias("_at"))
    one, two = placed.withColumnRenamed("_v", "_x"), placed.select(*keys, F.col("section").alias("_other"), F.col("_v").alias("_y"), "_at")
    pairs = one.join(two, [*keys, "_at"]).where("section <> _other").groupBy(*keys, "section", "_other").agg(F.avg(dot(F.col("_x"), F.col("_y"))).alias("_sim"))
    of = pairs.groupBy(*keys, "section").agg(F.max("_sim").alias("repetition"), F.array_sort(F.collect_list(F.when((F.col("_other") < F.col("section")) & (F.col("_sim") >= alike), F.col("_other")))).alias("_like"))
    every = rows.select(*keys, "section").distinct().join(of, [*keys, "section"], "left")

    def step(founders: dict | None, section: int, like: list | None):
        founders = founders if founders is not None else {}
        first = next((s for s in like or () if s in founders), None)
        if first is None:
            founders[section] = len(founders)
            first = section
        return founders, (founders[first],)

    return selection.scan(every, keys, ["section"], ["section", "_like"], "grp bigint", step).select(*keys, "section", "grp", F.coalesce("repetition", F.lit(0.0)).alias("repetition"))


def sections(df: DataFrame, keys: list[str], bar: str, vector: str, energy: str, low: str, clap: str, **rules) -> DataFrame:
    """keys, section, start, end (bars, half open), grp, energy, low and clap (means by bar), repetition and label.

    The hook is the group, found twice or more, of the highest mean of energy and twice the low beats (the first on a tie), unless it is over ``HOOK_BELOW`` softer than the
    loudest section. Sections with hardly a beat are the intro, the outro or a break, by place; else the first is the intro, a short one ``BREAK_BELOW`` softer than the
    hook and not last a break, a short last one the outro, and all others verses.
    """
    rows = bounded(df, keys, bar, vector, **rules)
    base = rows.groupBy(*keys, "section").agg(F.min(bar).alias("start"), (F.max(bar) + 1).alias("end"), F.avg(energy).alias("energy"), F.avg(low).alias("low"), F.avg(clap).alias("clap"))
    out = base.join(repeated(rows, keys, bar, vector), [*keys, "section"])
    groups = out.groupBy(*keys, "grp").agg(F.count("*").alias("_n"), F.avg(F.col("energy") + 2 * F.col("low")).alias("_force"), F.avg("energy").alias("_mean"))
    hook = groups.where("_n > 1").groupBy(*keys).agg(F.max_by(F.struct("grp", "_mean"), F.struct("_force", -F.col("grp"))).alias("_hook"))
    piece = out.groupBy(*keys).agg(F.max("energy").alias("_loudest"), F.max("section").alias("_last")).join(hook, keys, "left")
    heard = F.coalesce(F.col("_hook._mean") >= F.col("_loudest") - HOOK_BELOW, F.lit(False))
    piece = piece.select(*keys, "_last", F.when(heard, F.col("_hook.grp")).alias("_grp"), F.when(heard, F.col("_hook._mean")).otherwise(F.col("_loudest")).alias("_level"))
    first, last, short = F.col("section") == 0, F.col("section") == F.col("_last"), F.col("end") - F.col("start") <= SHORT
    silent = (F.col("low") < SILENT) & (F.col("clap") < SILENT)
    label = (
        F.when(F.coalesce(F.col("grp") == F.col("_grp"), F.lit(False)), "hook").when(silent & first, "intro").when(silent & last, "outro").when(silent, "break").when(first, "intro")
        .when((F.col("energy") < F.col("_level") - BREAK_BELOW) & short & ~last, "break").when(last & short, "outro").otherwise("verse")
    )
    return out.join(piece, keys).withColumn("label", label).drop("_last", "_grp", "_level")
