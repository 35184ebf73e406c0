"""Sections of a piece and speakers of a recording against plain programs."""

import random

import numpy as np
import pytest

from chronoweave.operators import sections, similarity, speakers


def plain_sections(v, energy, low, clap):
    """(start, end, group, label) by the matrix of all similarities and a checkerboard laid over it."""
    s, n = v @ v.T, len(v)
    board = np.outer(np.r_[-np.ones(4), np.ones(4)], np.r_[-np.ones(4), np.ones(4)])
    nov = [max(0.0, (s[i - 4 : i + 4, i - 4 : i + 4] * board).sum()) if 4 <= i < n - 4 else 0.0 for i in range(n)]
    place = max(range(4), key=lambda r: (sum(nov[r::4]), -r))
    open_ = [b for b in range(place, n, 4) if b > 0]
    least = 0.3 * max(max((nov[b] for b in open_), default=1), 1e-9)
    bounds = [0, *[b for b in open_ if nov[b] >= least], n]
    parts = list(zip(bounds, bounds[1:]))

    def like(p, q):
        m = min(p[1] - p[0], q[1] - q[0])
        return float(np.mean([s[p[0] + k, q[0] + k] for k in range(m)]))

    group, founders = [], []
    for k, p in enumerate(parts):
        own = next((g for g, f in enumerate(founders) if like(parts[f], p) >= 0.9), None)
        if own is None:
            own = len(founders)
            founders.append(k)
        group.append(own)
    e, l, c = ([float(np.mean(x[a:b])) for a, b in parts] for x in (energy, low, clap))
    twice = [g for g in range(len(founders)) if group.count(g) > 1]
    mean = {g: np.mean([e[k] for k, own in enumerate(group) if own == g]) for g in twice}
    hook = max(twice, key=lambda g: (np.mean([e[k] + 2 * l[k] for k, own in enumerate(group) if own == g]), -g), default=None)
    if hook is not None and mean[hook] < max(e) - 4:
        hook = None
    level = max(e) if hook is None else mean[hook]
    out = []
    for k, (a, b) in enumerate(parts):
        last = k == len(parts) - 1
        if group[k] == hook:
            label = "hook"
        elif l[k] < 0.3 and c[k] < 0.3:
            label = "intro" if k == 0 else "outro" if last else "break"
        elif k == 0:
            label = "intro"
        elif e[k] < level - 2.5 and b - a <= 8 and not last:
            label = "break"
        else:
            label = "outro" if last and b - a <= 8 else "verse"
        out.append((k, a, b, group[k], label))
    return out


def test_sections(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for song in range(40):
        kinds = rng.normal(size=(3, 5)) + 1.0
        plan = [int(rng.integers(3)) for _ in range(rng.integers(1, 9))]
        v = np.concatenate([kinds[k] + rng.normal(size=(int(rng.choice([4, 8, 12])), 5)) * 0.15 for k in plan])[int(rng.integers(3)) :]
        v /= np.linalg.norm(v, axis=1)[:, None]
        energy, low, clap = rng.normal(size=len(v)) * 3 - 20, rng.integers(0, 3, len(v)) * float(song % 3 > 0) * 1.0, np.zeros(len(v))
        want[song] = plain_sections(v, energy, low, clap)
        rows += [(song, k, v[k].tolist(), float(energy[k]), float(low[k]), 0.0, None) for k in range(len(v))]
    df = spark.createDataFrame(rows, "song long, bar long, v array<double>, e double, l double, c double, label string").repartition(4)
    got = {}
    for r in sections.sections(df, ["song"], "bar", "v", "e", "l", "c").orderBy("section").collect():
        got.setdefault(r.song, []).append((r.section, r.start, r.end, r.grp, r.label))
    assert got == want
    assert {s[4] for song in want.values() for s in song} == {"hook", "intro", "outro", "break", "verse"}
    assert sections.sections(df.limit(0), ["song"], "bar", "v", "e", "l", "c").count() == 0


def plain_path(scores, price=0.3):
    """The best labels by the best sums at every row."""
    best, came = [list(scores[0])], []
    for row in scores[1:]:
        top = max(range(len(row)), key=lambda k: (best[-1][k], -k))
        came.append([k if best[-1][k] >= best[-1][top] - price else top for k in range(len(row))])
        best.append([best[-1][c] - (price if c != k else 0) + x for k, (c, x) in enumerate(zip(came[-1], row))])
    label = [max(range(len(best[-1])), key=lambda k: (best[-1][k], -k))]
    for c in reversed(came):
        label.append(c[label[-1]])
    return label[::-1]


def plain_speakers(x, regions, number, rounds=3):
    cluster = similarity.average_linkage(x, 0.7, number)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    voices = unit(np.array([x[cluster == k].mean(0) for k in range(cluster.max() + 1)]))

    def labelled():
        label = np.zeros(len(x), int)
        for r in sorted(set(regions)):
            label[regions == r] = plain_path((x[regions == r] @ voices.T).tolist())
        return label

    for _ in range(rounds if number is None else 0):
        label = labelled()
        time = np.array([(label == k).sum() * 0.125 for k in range(len(voices))])
        means = {k: unit(x[label == k].mean(0, keepdims=True))[0] for k in range(len(voices)) if time[k] > 0}
        keep = [k for k in means if time[k] >= 1]
        for k in sorted((k for k in means if time[k] < 1), key=lambda k: (-time[k], k)):
            if not keep or max(means[k] @ means[j] for j in keep) < 0.4:
                keep.append(k)
        voices = np.array([means[k] for k in sorted(keep)])
    return labelled().tolist()


@pytest.mark.parametrize("number", [None, 3])
def test_speakers(spark, number):
    """Each round as in a plain loop that always runs all three; recordings settle at different rounds."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for rec in range(12):
        voice = rng.normal(size=(int(rng.integers(1, 5)), 6))
        x, regions = [], []
        for turn in range(int(rng.integers(2, 10))):
            n = int(rng.integers(1, 20))
            x.append(voice[rng.integers(len(voice))] + rng.normal(size=(n, 6)) * rng.choice([0.2, 0.9]))
            regions += [turn // 2] * n
        x = np.concatenate(x)
        x /= np.linalg.norm(x, axis=1)[:, None]
        want[rec] = plain_speakers(x, np.array(regions), number)
        rows += [(rec, regions[k], k, x[k].tolist(), None) for k in range(len(x))]
    rows += [(0, 0, 10_000, None, 1), (50, 0, 0, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "rec long, region int, i long, v array<double>, cluster int").repartition(4)
    got = {}
    for r in speakers.speakers(df, ["rec"], "region", "i", "v", number).orderBy("i").collect():
        got.setdefault(r.rec, []).append(r.speaker)
    assert got.pop(50) == [0] and got[0].pop() is None
    assert got == want
    assert speakers.speakers(df.limit(0), ["rec"], "region", "i", "v", number).count() == 0


def test_fixed_number_of_groups():
    rng = np.random.default_rng(2)
    for n in range(2, 12):
        x = rng.normal(size=(30, 4))
        assert len(set(similarity.average_linkage(x, 0.1, n).tolist())) == n
    assert set(similarity.average_linkage(np.ones((5, 3)), 0.1, 2).tolist()) == {0}
