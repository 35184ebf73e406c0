"""Peaks apart, transitions with labels, sample quality, the report of a reel and the overview of cameras, against plain programs."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import intervals, tracks
from chronoweave.sources import manifest


def test_spaced_peaks(spark):
    rng = random.Random(1)
    rows = [(g, t, float(rng.randint(0, 9))) for g in range(6) for t in range(300)]
    got = {}
    for r in intervals.spaced_peaks(spark.createDataFrame(rows, "g int, t long, x double").repartition(3), ["g"], "t", "x", 4.0, 7).collect():
        got.setdefault(r.g, set()).add(r.t)
    for g in range(6):
        x = [v for k, _, v in rows if k == g]
        tops = [t for t in range(1, 299) if x[t] >= 4 and x[t] > x[t - 1] and x[t] >= x[t + 1]]
        kept = []
        for t in sorted(tops, key=lambda t: (-x[t], t)):
            if all(abs(t - k) >= 7 for k in kept):
                kept.append(t)
        assert got[g] == set(kept)


def plain_transitions(f):
    n, t, out = len(f), 0, []
    hot = [r["many"] > 0.5 or r["single"] > 0.5 for r in f]
    while t < n:
        if not hot[t]:
            t += 1
            continue
        u = t
        while True:
            while u + 1 < n and hot[u + 1]:
                u += 1
            if u + 3 < n and (hot[u + 2] or hot[u + 3]):
                u += 2 if hot[u + 2] else 3
            else:
                break
        first = lambda key, places: max(places, key=lambda k: (f[k][key], -k))
        peak, label = first("single", range(t, u + 1)), "cut"
        score = f[peak]["single"]
        shares = [f[k]["share"] for k in range(t, u + 1) if f[k]["share"] is not None]
        if u - t >= 2 and len(shares) > 2 and all(b - a > -0.15 for a, b in zip(shares, shares[1:])) and max(f[k]["rest"] for k in range(t, u + 1)) < 0.6 and shares[0] < 0.6 and shares[-1] > 0.4:
            label = "blend"
        else:
            peak = first("change", range(max(1, t - 2), min(n, u + 3)))
        if 1 <= peak and peak + 5 < n and f[peak]["luma"] - f[peak - 1]["luma"] > 0.1 and f[peak]["back"] < 0.5 * max(f[peak]["change"], 1e-3):
            label = "flash"
        out.append((t, u, peak, score, label))
        t = u + 1
    return out


def test_transitions(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for clip in range(40):
        n, f, hot = rng.randint(5, 60), [], 0
        while len(f) < n:
            if not hot and rng.random() < 0.15:
                hot, size = rng.choice([1, 2, 4, 6]), 0
                size = hot
            share = None
            if hot:
                share = 1 - hot / size + rng.choice([0, 0, 0.1, -0.2])
            f.append(dict(single=round(rng.uniform(0.3, 1) if hot else rng.uniform(0, 0.4), 2), many=rng.choice([0.2, 0.6]) if hot else 0.1, change=round(rng.random(), 1), luma=round(rng.random(), 1), share=share, rest=rng.choice([0.1, 0.3, 0.7]), back=rng.choice([0.01, 0.4])))
            hot = max(0, hot - 1)
        want[clip] = plain_transitions(f)
        rows += [(clip, k, r["single"], r["many"], r["change"], r["luma"], r["share"], r["rest"], r["back"]) for k, r in enumerate(f)]
    df = spark.createDataFrame(rows, "clip int, i long, single double, many double, change double, luma double, share double, rest double, back double").repartition(4)
    got = {c: [] for c in want}
    for r in intervals.transitions(df, ["clip"], "i").orderBy("first").collect():
        got[r.clip].append((r.first, r.last, r.peak, r.score, r.label))
    assert got == want
    assert {x[4] for v in want.values() for x in v} == {"cut", "blend", "flash"}
    assert intervals.transitions(df.limit(0), ["clip"], "i").count() == 0


def test_sample_quality(spark):
    rng = random.Random(2)
    rows = [tuple(rng.uniform(0, m) for m in (300, 800, 255, 0.5, 0.7, 200, 900)) for _ in range(50)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, motion double, sharp double, luma double, hi double, lo double, shake double, camera double")
    column = [F.col(c) for c in ("motion", "sharp", "luma", "hi", "lo", "shake", "camera")]
    for k, _, r in [(r.k, 0, r) for r in df.select("k", tracks.sample_quality(*column).alias("a"), tracks.sample_quality(*column[:6]).alias("b")).collect()]:
        m, s, l, hi, lo, sh, cam = rows[k]
        exposure = min(1.0, max(0.2, 1 - max(0, 45 - l) / 45 - max(0, l - 215) / 40 - max(0, hi - 0.15) - max(0, lo - 0.35)))
        q = (1 - math.exp(-m / 120)) * min(1.0, max(0.35, s / 500)) * exposure * math.exp(-sh / 80)
        assert r.b == pytest.approx(q) and r.a == pytest.approx(q / (1 + cam / 500))


def test_reel_report(spark):
    rng = random.Random(3)
    rows = [(el, k, k // 3, rng.choice([0.5, 1.0, 2.0, 4.0]), rng.uniform(0.2, 3), rng.choice([True, False, None]), rng.uniform(-90, 90)) for el in range(5) for k in range(rng.randint(1, 20))]
    df = spark.createDataFrame(rows, "el int, n int, scene int, beats double, seconds double, jump boolean, away double")
    for r in tracks.reel_report(df, ["el"], "scene", "beats", "seconds", "jump", "away", "n").collect():
        own = [x for x in rows if x[0] == r.el]
        scenes = {}
        for x in own:
            scenes[x[2]] = scenes.get(x[2], 0) + x[3]
        assert (r.shots, r.scenes, r.jumps, r.on_beat) == (len(own), len(scenes), sum(bool(x[5]) for x in own), sum(abs(x[6]) <= 45 for x in own[1:]))
        assert (r.shot_beats, r.shot_seconds, r.scene_beats) == tuple(pytest.approx(statistics.median(v)) for v in ([x[3] for x in own], [x[4] for x in own], list(scenes.values())))


def test_overview(spark):
    rng = random.Random(4)
    clips = [(p, f"c{k}", None if rng.random() < 0.2 else rng.uniform(-5, 50), rng.uniform(0.1, 30), rng.choice([True, False, None])) for p in range(6) for k in range(rng.randint(1, 14))] + [(9, "x", None, 3.0, True)]
    got = {(r.p, r.clip): r.marks for r in manifest.overview(spark.createDataFrame(clips, "p int, clip string, start double, duration double, usable boolean"), ["p"], 30).collect()}
    for p in {c[0] for c in clips}:
        own = [c for c in clips if c[0] == p]
        placed = [c for c in own if c[2] is not None]
        low, count = (min(c[2] for c in placed), [0] * 30) if placed else (0, [0] * 30)
        step = max(max(c[2] + c[3] for c in placed) - low, 1e-6) / 30 if placed else 1
        for _, clip, start, duration, usable in own:
            marks = "-" * 30
            if start is not None:
                on = [min(low + (c + 1) * step, start + duration) - max(low + c * step, start) > 0.3 * step for c in range(30)]
                marks = "".join(("#" if usable else "?") if x else "." for x in on)
                count = [n + x for n, x in zip(count, on)]
            assert got[p, clip] == marks
        assert got[p, None] == "".join(str(min(n, 9)) if n else "." for n in count)
