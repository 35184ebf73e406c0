"""Recordings put on the time line of a reference through their best pairwise alignments.

The tree is the spanning tree of most confidence: in each round every part of a project takes its best edge to another part,
for all projects at once, so the number of rounds is logarithmic in the clips of the largest project and no
project is gathered. Time maps are then chained from the reference outwards, one step of the tree a round.

Edges of a project name two clips, a and b, once: ``offset`` is the time in a of b's time ``at``, less ``at``; ``drift`` (ppm) counts if it is sure.
An edge is good if it is a hit, isn't ambiguous and has ``least`` confidence. Null flags are false, a null confidence or drift is 0; edges
without a clip or an offset, between equal clips or with clips that the project doesn't have are ignored; of several edges of
one pair the best counts. Ties: the edge whose clips come first by name, then the smaller offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.sources import tables

LEAST_CONFIDENCE = 0.5
_EDGE = ("a", "b", "offset", "at", "drift", "confidence", "hit", "good")


def _struct(edge: str = "") -> Column:
    return F.struct(*(F.col(f"{edge}{c}").alias(c) for c in _EDGE))


def _order(direct: Column | None = None) -> Column:
    """Smallest first: edges at the reference, then the most confident, then by name."""
    parts = [-F.col("confidence"), F.least("a", "b"), F.greatest("a", "b"), F.col("a")]
    return F.struct(*([] if direct is None else [(~direct).cast("int").alias("d")]), *(c.alias(f"o{k}") for k, c in enumerate(parts)))


def _both_ways(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each edge from either end: keys, frm, to and the edge."""
    own = edges.select(*keys, _struct().alias("edge"))
    return own.select(*keys, F.col("edge.a").alias("frm"), F.col("edge.b").alias("to"), "edge").unionByName(own.select(*keys, F.col("edge.b").alias("frm"), F.col("edge.a").alias("to"), "edge"))


def strongest_tree(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str, order: Column) -> DataFrame:
    """The edges (a, b and what else they have) of the spanning forest that takes edges by ``order``, smallest first, of every key. The order must tell all edges of a key apart."""
    part = tables.written(nodes.select(*keys, F.col(node).alias("n"), F.col(node).alias("part")), "parts")
    left = tables.written(edges.withColumn("_o", order), "edges")
    names = [c for c in left.columns if c != "_o"]
    chosen = None
    while True:
        ends = left.join(part.select(*keys, F.col("n").alias("a"), F.col("part").alias("pa")), [*keys, "a"]).join(part.select(*keys, F.col("n").alias("b"), F.col("part").alias("pb")), [*keys, "b"])
        open_ = tables.written(ends.where("pa <> pb"), "open")
        if open_.isEmpty():
            return left.select(*names).limit(0) if chosen is None else chosen.select(*names)
        sides = [open_.select(*keys, F.col(x).alias("part"), F.col(y).alias("other"), F.struct("_o", *[c for c in names if c not in keys]).alias("e")) for x, y in (("pa", "pb"), ("pb", "pa"))]
        best = sides[0].unionByName(sides[1]).groupBy(*keys, "part").agg(F.min_by(F.struct("other", "e"), "e._o").alias("m"))
        best = tables.written(best.select(*keys, "part", "m.other", "m.e"), "best")
        new = best.select(*keys, *(F.col(f"e.{c}").alias(c) for c in names if c not in keys)).distinct()
        chosen = tables.written(new if chosen is None else chosen.unionByName(new), "tree")
        # A part points to the one that its edge leads to; two that point to each other are the only rings.
        back = best.select(*keys, F.col("part").alias("other"), F.col("other").alias("back"))
        up = best.join(back, [*keys, "other"], "left").select(*keys, "part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("other")), F.col("part")).otherwise(F.col("other")).alias("up"))
        up = tables.written(up.unionByName(part.select(*keys, "part").distinct().join(up.select(*keys, "part"), [*keys, "part"], "left_anti").withColumn("up", F.col("part"))), "up")
        while True:
            twice = up.join(up.select(*keys, F.col("part").alias("up"), F.col("up").alias("top")), [*keys, "up"]).select(*keys, "part", F.col("top"), (F.col("up") != F.col("top")).alias("moved"))
            twice = tables.written(twice, "up")
            up = twice.select(*keys, "part", F.col("top").alias("up"))
            if twice.where("moved").isEmpty():
                break
        part = tables.written(part.join(up, [*keys, "part"]).select(*keys, "n", F.col("up").alias("part")), "parts")
        left = open_.select(*left.columns)


def _chained(reached: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """``reached`` and all clips that ``steps`` (keys, frm, to, edge) lead to from there, with their maps to the reference's time."""
    every = frontier = reached
    while True:
        # t_a = rate * t_b + shift; from the other end the inverse.
        rate, shift = F.lit(1.0) + F.col("edge.drift"), F.col("edge.offset") - F.col("edge.drift") * F.col("edge.at")
        forward = F.col("to") == F.col("edge.b")
        own_rate, own_shift = F.when(forward, rate).otherwise(1 / rate), F.when(forward, shift).otherwise(-shift / rate)
        new = frontier.withColumnRenamed("clip", "frm").join(steps, [*keys, "frm"]).join(every.select(*keys, F.col("clip").alias("to")), [*keys, "to"], "left_anti")
        new = new.select(
            *keys, F.col("to").alias("clip"), (F.col("rate") * own_rate).alias("rate"), (F.col("rate") * own_shift + F.col("shift")).alias("shift"),
            F.least("confidence", "edge.confidence").alias("confidence"), (F.col("sure") & F.col("edge.good")).alias("sure"), F.col("frm").alias("via"),
        )
        frontier = tables.written(new, "frontier")
        if frontier.isEmpty():
            return every
        every = tables.written(every.unionByName(frontier), "reached")


def synchronised(clips: DataFrame, edges: DataFrame, keys: list[str], least: float = LEAST_CONFIDENCE, tolerance: float = 0.010) -> tuple[DataFrame, DataFrame]:
    """Maps to the reference's time, and alignments that disagree with them.

    ``clips``: keys, clip, is_ref; ``edges``: keys, a, b, offset, at, drift, drift_sure, confidence, hit, ambiguous.
    Maps: keys, clip, rate, shift (time of the reference = rate * time + shift), confidence (of the weakest edge on the way), sure (good edges only) and
    via (the clip it hangs on), null for clips that nothing leads to. All clips with a good edge to the reference hang on it; then the most confident good
    edge from what is reached always comes next; what is left takes, in the order of names, its most confident hit among what is reached by then.
    Disagreeing: keys, a, b and off, the distance at ``at`` from the maps, of unambiguous hits outside the tree that are over ``tolerance`` off.
    """
    clips = tables.written(clips.select(*keys, "clip", F.coalesce("is_ref", F.lit(False)).alias("is_ref")).where("clip is not null").distinct(), "clips")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    own = edges.where("a is not null and b is not null and a <> b and offset is not null").select(
        *keys, "a", "b", F.col("offset").cast("double").alias("offset"), zero("at").alias("at"), F.when(yes("drift_sure"), zero("drift") * 1e-6).otherwise(0.0).alias("drift"), zero("confidence").alias("confidence"),
        yes("hit").alias("hit"), (yes("hit") & ~yes("ambiguous") & (zero("confidence") >= least)).alias("good"), (yes("hit") & ~yes("ambiguous")).alias("clear"),
    )
    named = own.join(clips.select(*keys, F.col("clip").alias("a"), F.col("is_ref").alias("ra")), [*keys, "a"]).join(clips.select(*keys, F.col("clip").alias("b"), F.col("is_ref").alias("rb")), [*keys, "b"])
    pair = [F.least("a", "b").alias("_l"), F.greatest("a", "b").alias("_g")]
    fields = [c for c in own.columns if c not in keys]
    one = named.groupBy(*keys, *pair).agg(F.min_by(F.struct(*fields, (F.col("ra") | F.col("rb")).alias("direct")), F.struct((~F.col("good")).cast("int"), (~F.col("hit")).cast("int"), _order(), "offset", "at", "drift")).alias("e"))
    one = tables.written(one.select(*keys, "e.*"), "edges")
    tree = strongest_tree(clips, one.where("good"), keys, "clip", _order(F.col("direct")))
    start = clips.where("is_ref").select(*keys, "clip", F.lit(1.0).alias("rate"), F.lit(0.0).alias("shift"), F.lit(1.0).alias("confidence"), F.lit(True).alias("sure"), F.lit(None).cast(dict(clips.dtypes)["clip"]).alias("via"))
    reached = _chained(start, _both_ways(tree, keys), keys)
    # What is left: reached if a hit leads to what was reached before, or to one of the rest that is reached and comes earlier by name.
    rest = clips.join(reached.select(*keys, "clip"), [*keys, "clip"], "left_anti").select(*keys, F.col("clip").alias("to"))
    hits = tables.written(_both_ways(one.where("hit"), keys).join(rest, [*keys, "to"]), "hits")
    base = reached.select(*keys, F.col("clip").alias("frm"))
    got = tables.written(hits.join(base, [*keys, "frm"], "left_semi").select(*keys, F.col("to").alias("frm")).distinct(), "rest")
    late = frontier = got
    while True:
        frontier = hits.where(F.col("frm") < F.col("to")).join(frontier, [*keys, "frm"], "left_semi").select(*keys, F.col("to").alias("frm")).distinct().join(late, [*keys, "frm"], "left_anti")
        frontier = tables.written(frontier, "rest")
        if frontier.isEmpty():
            break
        late = tables.written(late.unionByName(frontier), "late")
    allowed = hits.join(base, [*keys, "frm"], "left_semi").unionByName(hits.where(F.col("frm") < F.col("to")).join(late, [*keys, "frm"], "left_semi"))
    parents = allowed.groupBy(*keys, "to").agg(F.min_by(F.struct("frm", "edge"), F.struct((-F.col("edge.confidence")).alias("c"), "frm")).alias("p")).select(*keys, "p.frm", "to", "p.edge")
    maps = tables.written(_chained(reached, tables.written(parents, "parents"), keys), "maps")
    ends = [maps.select(*keys, F.col("clip").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("rate", "shift", "via"))) for x in ("a", "b")]
    both = one.where("clear").join(ends[0], [*keys, "a"]).join(ends[1], [*keys, "b"]).where("not (a_via <=> b) and not (b_via <=> a)")
    through = (F.col("b_rate") * F.col("at") + F.col("b_shift") - F.col("a_shift")) / F.col("a_rate")
    off = both.select(*keys, "a", "b", F.abs(F.col("at") + F.col("offset") - through).alias("off")).where(F.col("off") > tolerance)
    return clips.select(*keys, "clip").join(maps, [*keys, "clip"], "left"), off
