"""Steps that must not make more rows, shuffles or sorts than their input asks for: results against plain programs, and what the plans hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import aggregates, choice, edits, matching, signals, similarity, sync


@pytest.fixture
def large(spark):
    """Plans as for tables too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tolerance, kind", [(3, "long"), (0.75, "double")])
def test_votes_shuffle_only_events_and_marks(large, tolerance, kind):
    rng = random.Random(4)
    step = 1 if kind == "long" else 0.25
    events = [(g, k, rng.randrange(80) * step) for g in range(8) for k in range(g)] + [(None, 0, 1 * step), (3, None, 5 * step)]
    marks = [(g, rng.randrange(90) * step) for g in range(9) for _ in range(10)] + [(None, 2 * step)]
    e, m = large.createDataFrame(events, f"g int, o int, t {kind}"), large.createDataFrame(marks, f"g int, t {kind}")
    got = sync.vote_offset(e, m, ["g"], "t", "o", tolerance, first=4)
    assert plan(got).count("Exchange") == 2
    want = {}
    for g in range(1, 8):
        own, there = [(o, t) for k, o, t in events if k == g], [t for k, t in marks if k == g]
        rated = [(-len({o2 for o2, t2 in own if o2 is not None and any(abs(r2 - t2 - (r - t)) < tolerance for r2 in there)}), o, r - t) for o, t in own if o is not None and o < 4 for r in there]
        want[g] = (min(rated)[2], -min(rated)[0])
    assert {r.g: (r.offset, r.hits) for r in got.collect()} == want


def test_windows_of_all_lengths_from_one_sorting(large):
    rng = random.Random(5)
    songs = {s: [(rng.randrange(50), rng.randrange(3)) for _ in range(s)] for s in range(1, 9)}
    df = large.createDataFrame([(s, b, e, h) for s, bars in songs.items() for b, (e, h) in enumerate(bars)], "s int, b int, e long, h long").repartition(3)
    got = choice.song_windows(df, ["s"], "b", "e", "h", (4, 2))
    p = plan(got.drop("rank"))
    assert p.count("Exchange hashpartitioning") == 1 and p.count("Sort [") == 1
    want = {}
    for s, bars in songs.items():
        mean = sum(e for e, _ in bars) / len(bars)
        for n in (4, 2):
            for b in range(len(bars) - n + 1):
                part = bars[b : b + n]
                want[s, n, b] = sum(e for e, _ in part) / n - mean + 1.5 * sum(h for _, h in part) / n + (2.0 if part[-1][1] == 0 else 0.0)
    found = {(r.s, r.length, r.start): r.score for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_speed_curves_need_no_shuffle(large):
    shots = [(1, "normal", 4.0, None, 0.0), (2, "fast", 6.0, None, 0.0), (3, "freeze", 4.0, None, 1.0), (4, "ramp", 8.0, None, 0.0), (5, "speed", 3.0, 0.25, 0.0), (6, "ramp_hold", 5.0, None, None), (7, "slow", None, None, None)]
    df = large.createDataFrame(shots, "k int, mode string, beats double, v double, stop double").repartition(3)
    got = signals.speed_curve(df, ["k"], "mode", "beats", "v", "stop", 0.5, 8)
    assert plan(got).count("Exchange") == 1 and "Window" not in plan(got)  # the exchange is the test's own
    places = df.select("k", "mode", "v", "stop", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"), (F.col("i") * F.col("beats") / 8).alias("b"))
    speeds = {(r.k, r.i): (r.b, r.s) for r in places.select("k", "i", "b", signals.speed(F.col("mode"), F.col("b"), F.col("v"), F.col("stop")).alias("s")).collect()}
    found = {}
    for r in got.collect():
        found.setdefault(r.k, []).append((r.b, r.offset))
    for k, *_ in shots:
        total, want = 0.0, []
        for i in range(9):
            b, v = speeds[k, i]
            if i and b is not None:
                total += (v + speeds[k, i - 1][1]) / 2 * (b - speeds[k, i - 1][0])
            want.append((b, total * 0.5))
        assert sorted(found[k], key=lambda x: (x[0] or 0, x[1])) == sorted(want, key=lambda x: (x[0] or 0, x[1]))


def test_robust_lines_join_no_pairs(large):
    """Pairs of points are made inside their key's row, and the medians of a key's rows where they lie."""
    rng = random.Random(7)
    df = large.createDataFrame([(k % 9, float(rng.randrange(12)), rng.random()) for k in range(300)] + [(None, 1.0, 1.0), (None, 2.0, 2.0)], "k int, x double, y double")
    slopes = aggregates.theil_sen(df, ["k"], "x", "y")
    assert "Join" not in plan(slopes) and slopes.where("k is null").count() == 0
    assert plan(aggregates.robust_line(df, ["k"], "x", "y")).count("Join") == 1
    assert {r.k: r.n for r in aggregates.robust_line(df, ["k"], "x", "y").collect()}.keys() == set(range(9))


def test_keyword_windows_make_no_row_a_place(large):
    rng = random.Random(6)
    words = sorted({(c, rng.randrange(30), rng.choice("abcdef")) for c in range(6) for _ in range(25)}) + [(None, 1, "a"), (1, None, "a"), (1, 2, None)]
    sets = {1: {"a", "b"}, 2: {"c"}, 3: {"a", "c", "f"}, 4: {"z"}}
    w = large.createDataFrame(words, "c int, i int, t string").repartition(3)
    k = large.createDataFrame([(s, t) for s, ts in sets.items() for t in ts] + [(1, "a"), (None, "b"), (2, None)], "s int, t string")
    got = matching.keyword_windows(w, k, ["c"], "i", "t", "s", 8)
    assert "Generate" not in plan(got) and plan(got).count("Join") == 1
    want = {}
    for c, i, t in words:
        for s, ts in sets.items():
            if c is not None and i is not None and t in ts:
                inside = [u for d, j, u in words if d == c and j is not None and i <= j <= i + 8]
                want[c, i, s] = len(ts & set(inside)) + 0.01 * len(inside)
    rows = got.collect()
    assert {(r.c, r.i, r.s): r.score for r in rows} == pytest.approx(want) and len(rows) == len(want)


def test_edit_rules_join_shots_once(large):
    """Shots come with their list's figures from one table, whatever the number of rules."""
    from chronoweave.operators import rules
    from chronoweave.plans import edits as queries

    shots, lists = queries._lists(large, "/root/testdata/sf0.001")
    assert "Join" not in plan(shots) and plan(lists).count("Exchange") == 1
    for named, joins in ((edits.part_rules, 1), (edits.sound_rules, 3), (edits.effect_rules, 0)):
        assert plan(rules.findings(named(shots, lists))).count("Join") <= joins


def test_large_label_is_dealt(large):
    """Rows of a large key go to the group of nearest mean in parts of ``most`` rows, not all in the key's task."""
    rng = random.Random(8)
    rows = [(k % 2, k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(400)] + [(0, 1000, None), (2, 1001, [1.0, 0.0, 0.0, 0.0])]
    df = large.createDataFrame(rows, "g int, i int, v array<double>")
    found = similarity.grouped(df, ["g"], "i", "v", 0.5, 50)
    assert "FlatMapCoGroupsInPandas" in plan(found)
    got, drawn = {r.i: r.cluster for r in found.collect()}, {r.i: r.cluster for r in similarity.grouped(df, ["g"], "i", "v", 0.5, 50, means="sample").collect()}
    assert len(got) == 402 and got[1000] is None and got[1001] == 0
    for g in (0, 1):
        means = {}
        for k, i, v in rows:
            if k == g and i in drawn:
                means.setdefault(drawn[i], []).append(v)
        means = {c: [sum(x) / len(x) for x in zip(*vs)] for c, vs in means.items()}
        cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        for k, i, v in rows:
            if k == g and v:
                assert cosine(v, means[got[i]]) >= max(cosine(v, m) for m in means.values()) - 1e-12


def test_small_keys_are_grouped_many_a_batch(spark):
    """No call for each key; keys of one to nine rows, one with a null name, lie across batches of four rows."""
    rng = np.random.default_rng(3)
    rows = [(None if k == 11 else k, i, rng.normal(size=3 + k % 2).tolist()) for k in range(40) for i in range(1 + k % 9)]
    df = spark.createDataFrame([*rows, (5, 99, None)], "g int, i int, v array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = similarity.grouped(df, ["g"], "i", "v", 0.5, 50)
        got = {(r.g, r.i): r.cluster for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(5, 99): None}
    for g in {g for g, _, _ in rows}:
        own = [(i, v) for h, i, v in rows if h == g]
        want |= {(g, i): int(c) for (i, _), c in zip(own, similarity.average_linkage(np.array([v for _, v in own]), 0.5))}
    assert got == want
    assert similarity.grouped(df.limit(0), ["g"], "i", "v", 0.5, 50).count() == 0
    small = similarity.grouped(df, ["g"], "i", "v", 0.5, 50, means="sample")
    assert "FlatMapGroupsInPandas" not in plan(small)


def test_large_keys_are_linked_row_by_row(spark, monkeypatch):
    """All rows of large keys take part, one key null, in blocks of some sixty clusters: with copies, multiples, vectors of no length and rows without one."""
    monkeypatch.setattr(similarity, "BLOCK", 64)
    rng = np.random.default_rng(4)
    rows = []
    for g, n in ((None, 220), (1, 130), (2, 5), (3, 40)):
        x = rng.normal(size=(12, 6))[rng.integers(0, 12, n)] + rng.normal(size=(n, 6)) * 0.3
        x[::17], x[20:60], x[60:70] = 0, x[3], 3 * x[4]
        rows += [(g, int(i), x[i].tolist()) for i in rng.permutation(n)]
    df = spark.createDataFrame([*rows, (None, 1000, None), (2, 1000, None)], "g int, i int, v array<double>")
    got = {(r.g, r.i): r.cluster for r in similarity.linked(df, ["g"], "i", "v", 0.3, 40).collect()}
    want = {(None, 1000): None, (2, 1000): None}
    for g in (None, 1, 2, 3):
        own = sorted((i, v) for h, i, v in rows if h == g)
        want |= {(g, i): int(c) for (i, _), c in zip(own, similarity.average_linkage(np.array([v for _, v in own]), 0.3))}
    assert got == want and 20 < len({(g, c) for (g, _), c in got.items()}) < 250
    assert similarity.linked(df.limit(0), ["g"], "i", "v", 0.3, 40).count() == 0


def test_average_linkage_takes_all_rows(spark, tmp_path):
    """A label of over 1500 rows is not grouped by a sample of them."""
    from chronoweave.plans import catalog

    x = np.random.default_rng(6).normal(size=(1700, 8)).astype("float32")
    spark.createDataFrame([(i, v, 7) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.cluster for r in catalog.average_linkage(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(similarity.average_linkage(x.astype(float), 0.7).tolist()))
