"""Ranked and sequential choice.

Priority choice is a window. Where a choice depends on the choices before it (spacing, limiters, followers, label paths,
groups of words), rows are dealt by key, sorted inside the partition and read as a stream by ``scan``: the state of one key
is carried from batch to batch and is of bounded size, so a key of any length needs no memory of its own, and one
shuffle serves any number of passes over the same keys.

Nulls: rows with a null key form a key of their own; a null value is given to the step as None, and each operator says
what it does with it. Ties in the order are for the caller to end with a unique column. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[..., tuple[Any, tuple]]


def first_by_priority(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The k first rows of each key; end the order with a unique column."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def first_level(df: DataFrame, keys: list[str], levels: list[Column], order: list[Column]) -> DataFrame:
    """The best row of the first level that any row of the key meets; rows that meet none are left out."""
    level = F.coalesce(*[F.when(c, n) for n, c in enumerate(levels)])
    return first_by_priority(df.withColumn("level", level).where("level is not null"), keys, [F.col("level"), *order])


def scan(df: DataFrame, keys: list[str], order: list[Column | str], values: list[str], out: str, step: Step, dealt: bool = False) -> DataFrame:
    """Rows with further columns ``out`` (a DDL list) that ``step(state, *values)`` gives along the order of each key.

    The state is None at a key's first row; a step returns the new state and the values of the new columns. ``dealt`` says
    that the rows lie together by these keys already (from an earlier scan over them), which saves the shuffle.
    """
    if not dealt:
        df = df.repartition(*keys)
    rows = df.sortWithinPartitions(*keys, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), out])
    new = df.sparkSession.createDataFrame([], out).schema
    names, kinds = df.columns, [(f.name, pa_type(f.dataType.simpleString())) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Any = None
        state = None
        for batch in batches:
            columns = [batch.column(names.index(v)).to_pylist() for v in values]
            found: list[tuple] = []
            for k, key in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in keys), strict=True)):
                if key != at:
                    at, state = key, None
                state, row = step(state, *(c[k] for c in columns))
                found.append(row)
            made = [pa.array([r[n] for r in found], t) for n, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *(n for n, _ in kinds)])

    return rows.mapInArrow(run, schema)


def pa_type(ddl: str) -> pa.DataType:
    """Arrow type of the few types that scans return."""
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.list_(plain[ddl[6:-1]]) if ddl.startswith("array<") else plain[ddl]


def spaced_top(df: DataFrame, keys: list[str], t: str, score: str, spacing: float, n: int, enough: int = 3, share: float = 0.5) -> DataFrame:
    """Highest scores that keep ``spacing`` from one another: keys, t, score, rank from 1. It ends at n, or with ``enough`` picked once a score is under ``share`` of the best. Rows without a time or score are no candidates; of equal scores the earlier comes first."""

    def step(picked: list | None, at, value):
        picked = picked if picked is not None else []
        best = picked[0][1] if picked else value
        ended = len(picked) >= n or (len(picked) >= enough and value < share * best)
        if ended or any(abs(at - other) < spacing for other, _ in picked):
            return picked, (None,)
        picked.append((at, value))
        return picked, (len(picked),)

    rows = df.select(*keys, t, score).where(F.col(t).isNotNull() & F.col(score).isNotNull())
    return scan(rows, keys, [F.desc(score), F.col(t)], [t, score], "rank int", step).where("rank is not null")


def merged_cuts(df: DataFrame, keys: list[str], start: str, end: str, why: str, near: float = 0.02, least: float = 0.03) -> DataFrame:
    """Cuts that begin at most ``near`` after the end reached are one cut with all reasons, joined by +; a cut that joins none and is shorter than ``least`` is dropped and bridges nothing.

    The scan only numbers the cuts; the numbers are then grouped.
    """

    def step(state: tuple | None, a, b):
        number, reached = state or (0, float("-inf"))
        if a > reached + near:
            if b - a < least:
                return (number, reached), (None,)
            number, reached = number + 1, b
        return (number, max(reached, b)), (number,)

    rows = scan(df.select(*keys, start, end, why).where(F.col(start).isNotNull() & F.col(end).isNotNull()), keys, [start, end, why], [start, end], "cut bigint", step)
    reasons = F.array_sort(F.collect_list(F.struct(start, end, why)))
    return rows.where("cut is not null").groupBy(*keys, "cut").agg(F.min(start).alias(start), F.max(end).alias(end), F.array_join(F.transform(reasons, lambda r: r[why]), "+").alias(why)).drop("cut")


def limited(df: DataFrame, keys: list[str], order: list[str], target: str, attack: float, release: float, name: str = "level") -> DataFrame:
    """A curve that begins at its first target and then moves towards each by at most ``attack`` down and ``release`` up a row; a null target moves nothing."""

    def step(level, aim):
        if level is None:
            level = aim
        elif aim is not None:
            level += min(max(aim - level, -attack), release)
        return level, (level,)

    return scan(df, keys, order, [target], f"{name} double", step)


def followed(df: DataFrame, keys: list[str], order: list[str], target: str, dead: float, most: float, name: str = "position") -> DataFrame:
    """A position that begins at its first target, rests while the target is within ``dead`` of it, and else makes good what is beyond by at most ``most`` a row; a null target moves nothing."""

    def step(position, aim):
        if position is None or aim is None:
            position = aim if position is None else position
        else:
            beyond = max(abs(aim - position) - dead, 0.0)
            position += min(beyond, most) * (1 if aim > position else -1)
        return position, (position,)

    return scan(df, keys, order, [target], f"{name} double", step)


#: Share of the window that the subject may move in, window widths a second, seconds that the window looks ahead, of the running median and of the smoothing's deviation.
DEAD_SHARE, SPEED, AHEAD, MEDIAN_SECONDS, SMOOTH = 0.15, 0.5, 0.4, 0.8, 0.3


def _around(value: str, keys: list[str], order: list[str], reach: int) -> Column:
    """The values of ``reach`` rows to each side and of the row, with the first and last value of the key repeated beyond its ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = w.rowsBetween(-reach, reach)
    ends = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.row_number().over(w) - 1
    after = F.count(F.lit(1)).over(ends) - 1 - before
    pad = lambda v, have: F.array_repeat(v, F.greatest(F.lit(0), F.lit(reach) - have).cast("int"))
    return F.concat(pad(F.first(value).over(ends), before), F.collect_list(value).over(near), pad(F.last(value).over(ends), after))


def filled(df: DataFrame, keys: list[str], t: str, value: str, default: Column, name: str = "filled") -> DataFrame:
    """Rows with the value, linear in ``t`` between known ones, the nearest known one beyond them, and ``default`` where a key has none."""
    w = Window.partitionBy(*keys).orderBy(t)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v")))
    rows = df.withColumn("_b", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    between = F.when(F.col("_a.t") > F.col("_b.t"), F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(t) - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))).otherwise(F.col("_b.v"))
    return rows.withColumn(name, F.coalesce(between, F.col("_b.v"), F.col("_a.v"), default)).drop("_a", "_b")


def running_median(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, name: str = "median") -> DataFrame:
    """Rows with the median of the ``size`` (odd) rows around each, the ends repeated."""
    return df.withColumn(name, F.element_at(F.array_sort(_around(value, keys, order, size // 2)), size // 2 + 1))


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, deviation: float, name: str = "smooth") -> DataFrame:
    """Rows with the mean of the rows around each by a bell curve of so many rows' deviation, cut off at four of them, the ends repeated."""
    reach = int(4 * deviation + 0.5)
    weights = [math.exp(-0.5 * (k / deviation) ** 2) for k in range(-reach, reach + 1)]
    weights = F.array(*(F.lit(x / sum(weights)) for x in weights))
    return df.withColumn(name, F.aggregate(F.zip_with(_around(value, keys, order, reach), weights, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def reframed(df: DataFrame, keys: list[str], t: str, target: str, fps: float, width: float, window: float, dead: float = DEAD_SHARE, speed: float = SPEED, ahead: float = AHEAD, smooth: float = SMOOTH, name: str = "position") -> DataFrame:
    """Rows, one a frame in order of ``t`` (not null, unique in its key), with the place of a window of ``window`` in a picture of ``width`` that follows the targets (null where nothing is seen).

    Gaps are bridged (the middle of the picture where a key has no target), outliers taken out by a running median, and the window looks ahead; it then rests while the target
    is near, goes after it at a bounded speed, and its way is smoothed.
    """
    rows = filled(df, keys, t, target, F.lit((width - window) / 2.0), "_z")
    rows = running_median(rows, keys, [t], "_z", max(3, int(fps * MEDIAN_SECONDS) | 1), "_m")
    lead = round(ahead * fps)
    w = Window.partitionBy(*keys).orderBy(t)
    last = F.last("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_l", F.coalesce(F.lead("_m", lead).over(w), last) if lead else F.col("_m"))
    rows = followed(rows, keys, [t], "_l", dead * window, speed * window / fps, "_p")
    rows = smoothed(rows, keys, [t], "_p", smooth * fps, "_s")
    return rows.withColumn(name, F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(float(width - window)))).drop("_z", "_m", "_l", "_p", "_s")


def label_path(df: DataFrame, keys: list[str], order: list[str], scores: str, penalty: float, name: str = "label") -> DataFrame:
    """The label (place in the array ``scores``) of every row that makes the sum of scores less ``penalty`` per change of label largest. On ties a label is kept rather than changed, and the first label wins.

    Two scans over one dealing of the rows: forward with the best sum per label and the label each came from, then
    backward from the best last label. Rows must have scores of one length.
    """

    def forward(sums: list | None, own: list):
        if sums is None:
            sums, came = [0.0] * len(own), list(range(len(own)))
        else:
            top = sums.index(max(sums))
            came = [k if s >= sums[top] - penalty else top for k, s in enumerate(sums)]
            sums = [sums[c] - (penalty if c != k else 0.0) for k, c in enumerate(came)]
        sums = [s + x for s, x in zip(sums, own, strict=True)]
        return sums, (came, sums.index(max(sums)))

    def backward(label, came: list, best: int):
        label = best if label is None else label
        return came[label], (label,)

    there = scan(df, keys, order, [scores], "_came array<bigint>, _best bigint", forward)
    back = scan(there, keys, [F.desc(o) for o in order], ["_came", "_best"], f"{name} bigint", backward, dealt=True)
    return back.drop("_came", "_best")


#: Words that a group should not end on (fixed values).
BINDING_WORDS = frozenset(
    "der die das den dem des ein eine einen einem einer und oder aber auf mit von vom zu zum zur für in im an am aus bei nach über unter vor dass weil wenn wie als".split()
)
#: Price of a group of one, two or three words, and of one that ends on a binding word (fixed values).
GROUP_PRICES, BINDING_PRICE = (2.0, 0.15, 0.10), 1.5


def word_groups(df: DataFrame, keys: list[str], order: list[str], word: str, width: str, hard: str, room: float, name: str = "grp") -> DataFrame:
    """Number, from 0 within a key, of the group of up to three words that each word stands in, for the least sum of prices.

    No group reaches over a row where ``hard`` is true (the word begins anew after a pause, a full stop or a comma), and
    none of two words or more is wider than ``room`` (widths and single spaces). Of equal sums the longer last group wins.
    Forward, a row keeps the best sums that end at it and at the two words before; backward, the groups are read off.
    """

    def cheapest(before: list[tuple[float, float]], binding: bool) -> tuple[float, int]:
        """Least sum of prices up to the last of these words, and the size of the group that it ends; entries are (sum before the word, its width)."""
        best = (float("inf"), 1)
        for k in range(len(before), 0, -1):
            if k > 1 and sum(x for _, x in before[-k:]) + k - 1 > room:
                continue
            price = before[-k][0] + GROUP_PRICES[k - 1] + (BINDING_PRICE if binding and k > 1 else 0.0)
            if price < best[0] - 1e-9:
                best = (price, k)
        return best

    def forward(state, binding, x, begins):
        total, before = state or (0.0, [])
        before = [*([] if begins else before), (total, x)][-len(GROUP_PRICES) :]
        # A group may end on a binding word at a hard bound; the row after this one tells, so both answers are kept.
        (total, inner), (_, last) = cheapest(before, binding), cheapest(before, False)
        return (total, before), (inner, last)

    def backward(state, inner, last, begins):
        left, ends_block = state or (0, True)
        if not left:
            left = last if ends_block else inner
        return (left - 1, bool(begins)), (left == 1,)

    binding = F.lower(F.regexp_replace(word, r"[^\p{L}]", "")).isin(*sorted(BINDING_WORDS))
    rows = df.withColumn("_binding", F.coalesce(binding, F.lit(False))).withColumn("_hard", F.coalesce(F.col(hard), F.lit(False)))
    there = scan(rows, keys, order, ["_binding", width, "_hard"], "_inner bigint, _last bigint", forward)
    back = scan(there, keys, [F.desc(o) for o in order], ["_inner", "_last", "_hard"], "_first boolean", backward, dealt=True)
    starts = F.sum(F.col("_first").cast("long")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return back.withColumn(name, starts - 1).drop("_binding", "_hard", "_inner", "_last", "_first")


def assigned_once(slots: DataFrame, pool: DataFrame, keys: list[str], slot_order: list[str], order: list[Column], slot: str, clip: str, kind: str, pools: list[str] | None = None) -> DataFrame:
    """Each slot's clip: keys, slot, clip. Slots of a key choose one after the other; each takes the first clip, by ``order``, of its kind that none before took; null without any.

    ``kind`` is a column of both: a slot has one kind, and the pool a row for every kind that a clip fits. Clips of a kind are ranked once, and a slot moves a pointer over them, so what is read
    is slots and clips, never their pairs. A kind needs no more clips than its key has slots, as each of those takes one at most; that bounds what the scan carries. Slots are told apart by ``slot`` within their keys;
    null keys and kinds are keys and kinds of their own. Keys that share pools name by ``pools`` the columns of both that say whose a clip is (``keys`` if absent): a pool is ranked once for all of its keys, and each key
    asks for as many ranks of its kinds as it has slots.
    """
    own = list(dict.fromkeys([*slot_order, slot]))
    pools = keys if pools is None else pools
    at = F.row_number().over(Window.partitionBy(*pools, kind).orderBy(*order))
    ranked = pool.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(pools)), F.col(kind).alias("_k"), F.col(clip).cast("string").alias("_clip"), at.alias("_r"))
    asked = slots.withColumn("_slots", F.count("*").over(Window.partitionBy(*keys))).select(*dict.fromkeys([*keys, *pools]), F.col(kind).alias("_kind"), "_slots").distinct()
    asked = asked.withColumn("_rank", F.explode(F.sequence(F.lit(1), F.col("_slots").cast("int"))))
    # No key asks for a higher rank than the longest has slots, so of a shared pool little is left to join.
    ranked = ranked.join(F.broadcast(slots.groupBy(*keys).count().agg(F.max("count").alias("_most"))), F.col("_r") <= F.col("_most")).drop("_most")
    held = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(pools)]
    sized = asked.join(ranked, [*held, F.col("_kind").eqNullSafe(F.col("_k")), F.col("_rank") == F.col("_r")]).select(*keys, "_kind", "_clip", "_rank")
    rows = slots.select(*keys, F.col(kind).alias("_kind"), *own).withColumn("_is_slot", F.lit(True))
    both = rows.unionByName(sized.withColumn("_is_slot", F.lit(False)), allowMissingColumns=True)

    def step(state: tuple | None, is_slot, kind_, clip_):
        lists, places, taken = state or ({}, {}, set())
        if not is_slot:
            lists.setdefault(kind_, []).append(clip_)
            return (lists, places, taken), (None,)
        wanted, place = lists.get(kind_, ()), places.get(kind_, 0)
        while place < len(wanted) and wanted[place] in taken:
            place += 1
        choice = wanted[place] if place < len(wanted) else None
        if choice is not None:
            taken.add(choice)
        places[kind_] = place
        return (lists, places, taken), (choice,)

    out = scan(both, keys, ["_is_slot", *slot_order, "_kind", "_rank"], ["_is_slot", "_kind", "_clip"], f"`{clip}` string", step)
    return out.where("_is_slot").select(*keys, slot, clip)


def spread_choice(df: DataFrame, keys: list[str], part: str, order: list[Column], at: str, clip: str, cap: int, spacing: float) -> DataFrame:
    """Candidates chosen part by part, in the given order within a part: at most ``cap`` a part, ``spacing`` apart there, and each clip once in all parts of a key. The chosen rows, with their rank in the part."""

    def step(state: tuple | None, own_part, place, name):
        used, now, places = state or (set(), None, [])
        if own_part != now:
            now, places = own_part, []
        chosen = name not in used and len(places) < cap and all(abs(place - other) >= spacing for other in places)
        if chosen:
            used.add(name)
            places = [*places, place]
        return (used, now, places), (len(places) if chosen else None,)

    return scan(df, keys, [F.col(part), *order], [part, at, clip], "rank int", step).where("rank is not null")
