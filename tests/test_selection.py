"""Sequential choices against plain versions: every key by itself, in order, over several batches."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import selection


@pytest.fixture
def small_batches(spark):
    """Batches of a few rows, so that state is carried from one to the next."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def test_spaced_top(spark, small_batches):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 40), rng.randint(0, 9)) for g in range(6) for _ in range(25)] + [(7, None, 3), (7, 2, None)]
    got = {tuple(r) for r in selection.spaced_top(spark.createDataFrame(rows, "g int, t int, v int"), ["g"], "t", "v", 4, 5, 3, 0.5).collect()}
    want = set()
    for g in range(6):
        picked = []
        for t, v in sorted({(t, v) for k, t, v in rows if k == g}, key=lambda x: (-x[1], x[0])):
            if len(picked) == 5 or (len(picked) >= 3 and v < 0.5 * picked[0][1]):
                break
            if all(abs(t - p) >= 4 for p, _ in picked):
                picked.append((t, v))
        want |= {(g, t, v, k) for k, (t, v) in enumerate(picked, 1)}
    assert got == want


def test_merged_cuts(spark, small_batches):
    rows = [(1, 0.0, 1.0, "a"), (1, 1.01, 2.0, "b"), (1, 3.0, 3.01, "c"), (1, 3.02, 4.0, "d"), (2, 0.0, 0.01, "x"), (2, 5.0, None, "y"), (2, 1.0, 5.0, "z"), (2, 2.0, 3.0, "w")]
    got = sorted(tuple(r) for r in selection.merged_cuts(spark.createDataFrame(rows, "g int, s double, e double, why string"), ["g"], "s", "e", "why").select("g", "s", "e", "why").collect())
    assert got == [(1, 0.0, 2.0, "a+b"), (1, 3.02, 4.0, "d"), (2, 1.0, 5.0, "z+w")]


def test_curves(spark, small_batches):
    aims = [0.0, None, 0.0, 1.0, 1.0, 0.2, None]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(aims)] + [(2, 0, None), (2, 1, 5.0)], "g int, i int, x double")
    level = {(r.g, r.i): r.level for r in selection.limited(df, ["g"], ["i"], "x", 0.5, 0.25).collect()}
    assert [level[1, i] for i in range(7)] == [0.0, 0.0, 0.0, 0.25, 0.5, 0.2, 0.2] and level[2, 0] is None and level[2, 1] == 5.0
    place = {(r.g, r.i): r.position for r in selection.followed(df, ["g"], ["i"], "x", 0.5, 0.25).collect()}
    assert [place[1, i] for i in range(7)] == [0.0, 0.0, 0.0, 0.25, 0.5, 0.5, 0.5]


def test_label_path_is_the_best_of_all(spark, small_batches):
    rng = random.Random(4)
    keys = {g: [[rng.randint(0, 6) for _ in range(3)] for _ in range(rng.randint(1, 7))] for g in range(25)}
    df = spark.createDataFrame([(g, i, x) for g, xs in keys.items() for i, x in enumerate(xs)], "g int, i int, x array<int>")
    got = {}
    for r in selection.label_path(df, ["g"], ["i"], "x", 2.0).orderBy("g", "i").collect():
        got.setdefault(r.g, []).append(r.label)

    def total(xs, path):
        return sum(x[k] for x, k in zip(xs, path, strict=True)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))

    for g, xs in keys.items():
        assert total(xs, got[g]) == max(total(xs, p) for p in itertools.product(range(3), repeat=len(xs)))


def test_word_groups_are_the_cheapest_of_all(spark, small_batches):
    rng = random.Random(5)
    vocabulary = ["der", "und", "Haus", "laufen", "am", "Seeufer", "gross,", "ja."]
    turns = {g: [rng.choice(vocabulary) for _ in range(rng.randint(1, 8))] for g in range(30)}
    rows = [(g, i, w, float(len(w)), bool(i) and ws[i - 1][-1] in ".,") for g, ws in turns.items() for i, w in enumerate(ws)]
    got = {}
    for r in selection.word_groups(spark.createDataFrame(rows, "g int, i int, w string, width double, hard boolean"), ["g"], ["i"], "w", "width", "hard", 14.0).orderBy("g", "i").collect():
        got.setdefault(r.g, []).append(r.grp)

    def price(ws, numbers):
        groups = [[i for i, n in enumerate(numbers) if n == k] for k in range(numbers[-1] + 1)]
        total = 0.0
        for g in groups:
            if len(g) > 3 or any(ws[i - 1][-1] in ".," for i in g[1:]) or (len(g) > 1 and sum(len(ws[i]) for i in g) + len(g) - 1 > 14):
                return float("inf")
            last = g[-1]
            inner = last + 1 < len(ws) and ws[last][-1] not in ".,"
            total += (2.0, 0.15, 0.10)[len(g) - 1] + (1.5 if inner and len(g) > 1 and ws[last].strip(".,").lower() in selection.BINDING_WORDS else 0)
        return total

    for g, ws in turns.items():
        ways = (list(itertools.accumulate((0, *steps))) for steps in itertools.product((0, 1), repeat=len(ws) - 1))
        assert got[g][0] == 0 and abs(price(ws, got[g]) - min(price(ws, w) for w in ways)) < 1e-6, (ws, got[g])


def plain_reframed(ts, targets, fps, width, window):
    """Frame by frame, with lists that repeat their ends."""
    known = [(t, z) for t, z in zip(ts, targets) if z is not None]
    if not known:
        z = [(width - window) / 2] * len(ts)
    else:
        z = np.interp(ts, *zip(*known)).tolist()

    def near(values, k, reach):
        return [values[min(max(j, 0), len(values) - 1)] for j in range(k - reach, k + reach + 1)]

    h = max(3, int(fps * 0.8) | 1) // 2
    m = [sorted(near(z, k, h))[h] for k in range(len(z))]
    lead = round(0.4 * fps)
    aim = [m[min(k + lead, len(m) - 1)] for k in range(len(m))]
    p, out = aim[0], []
    for a in aim:
        d = a - p
        if abs(d) > 0.15 * window:
            p += (1 if d > 0 else -1) * min(abs(d) - 0.15 * window, 0.5 * window / fps)
        out.append(p)
    r = int(4 * 0.3 * fps + 0.5)
    bell = np.exp(-0.5 * (np.arange(-r, r + 1) / (0.3 * fps)) ** 2)
    bell /= bell.sum()
    return [min(max(float(np.dot(near(out, k, r), bell)), 0.0), width - window) for k in range(len(out))]


def test_reframed(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for clip in range(12):
        n = int(rng.integers(1, 120))
        ts = np.cumsum(rng.choice([0.1, 0.1, 0.1, 0.3], n)).tolist()
        level = np.repeat(rng.uniform(0, 600, 1 + n // 20), 20)[:n] + rng.normal(size=n) * 40
        targets = [None if clip == 3 or rng.random() < 0.3 else float(min(max(x, 0), 640)) for x in level]
        want[clip] = plain_reframed(ts, targets, 10.0, 1000, 360)
        rows += [(clip, t, z, None) for t, z in zip(ts, targets)]
    df = spark.createDataFrame(rows, "clip int, t double, x double, filled double").repartition(4)
    got = {}
    for r in selection.reframed(df, ["clip"], "t", "x", 10.0, 1000, 360).orderBy("t").collect():
        got.setdefault(r.clip, []).append(r.position)
    assert set(got) == set(want)
    for clip, places in want.items():
        assert got[clip] == pytest.approx(places, abs=1e-9), clip
    assert selection.reframed(df.limit(0), ["clip"], "t", "x", 10.0, 1000, 360).count() == 0


def test_assigned_once(spark):
    """Against slots that look through all clips in turn; clips fit several kinds, keys and kinds may be null."""
    rng = random.Random(12)
    slots = [(el, k, rng.choice(["x", "y", None])) for el in [None, *range(20)] for k in range(rng.randint(1, 12))]
    pool = [(el, f"c{k}", rng.randint(0, 5), kind) for el in [None, *range(19)] for k in range(rng.randint(0, 15)) for kind in rng.sample(["x", "y", "z", None], rng.randint(1, 3))]
    got = {(r.el, r.slot): r.clip for r in selection.assigned_once(spark.createDataFrame(slots, "el int, slot int, kind string").repartition(3), spark.createDataFrame(pool, "el int, clip string, score int, kind string").repartition(3), ["el"], ["slot"], [F.desc("score"), F.col("clip")], "slot", "clip", "kind").collect()}
    want, taken = {}, set()
    for el, k, kind in slots:
        free = sorted((-score, c) for e, c, score, own in pool if e == el and own == kind and (el, c) not in taken)
        want[el, k] = free[0][1] if free else None
        taken.add((el, want[el, k]))
    assert got == want and None in want.values()
    none = spark.createDataFrame([], "el int, slot int, kind string")
    assert selection.assigned_once(none, spark.createDataFrame([], "el int, clip string, score int, kind string"), ["el"], ["slot"], [F.col("clip")], "slot", "clip", "kind").count() == 0


def test_scans_of_empty_tables(spark):
    none = spark.createDataFrame([], "g int, i int, x double, w string, h boolean, s array<double>")
    assert selection.limited(none, ["g"], ["i"], "x", 1, 1).count() == selection.label_path(none, ["g"], ["i"], "s", 1.0).count() == 0
    assert selection.word_groups(none, ["g"], ["i"], "w", "x", "h", 1.0).count() == 0


def test_shared_pools_are_ranked_once(spark):
    rng = random.Random(8)
    slots = [(el, el % 3 if el % 7 else None, s, rng.choice([0, 1, None])) for el in range(60) for s in range(rng.randint(1, 5))]
    clips = [(g, f"c{k}", rng.randrange(4), kind) for g in (0, 1, None) for k in range(6) for kind in (0, 1, None) if rng.random() < 0.6]
    want = {}
    for el in range(60):
        taken = set()
        for _, g, s, kind in [x for x in slots if x[0] == el]:
            free = [c for _, _, c in sorted((-score, name, name) for pg, name, score, k in clips if pg == g and k == kind and name not in taken)]
            want[el, s] = free[0] if free else None
            taken.update(free[:1])
    out = selection.assigned_once(spark.createDataFrame(slots, "el int, g int, slot int, kind int").repartition(3), spark.createDataFrame(clips, "g int, clip string, score int, kind int").repartition(3), ["el"], ["slot"], [F.desc("score"), F.col("clip")], "slot", "clip", "kind", ["g"])
    assert {(r.el, r.slot): r.clip for r in out.collect()} == want
