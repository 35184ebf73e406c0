"""The tree of synchronised recordings against a plain program that adds one recording after the other."""

import random

from chronoweave.operators import trees

CLIPS = "pr long, clip string, is_ref boolean, part string"
EDGES = "pr long, a string, b string, offset double, at double, drift double, drift_sure boolean, confidence double, hit boolean, ambiguous boolean, via string"


def plain(clips, edges):
    """{clip: (rate, shift, confidence, sure, via)} of one project, and its disagreeing pairs."""
    one = {}
    for a, b, offset, at, drift, drift_sure, confidence, hit, ambiguous in edges:
        if a is None or b is None or a == b or offset is None or a not in clips or b not in clips:
            continue
        good = bool(hit) and not ambiguous and (confidence or 0) >= 0.5
        d = (drift or 0) * 1e-6 if drift_sure else 0.0
        key = (not good, not hit, -(confidence or 0), min(a, b), max(a, b), a, offset, at or 0.0, d)
        e = dict(a=a, b=b, d=d, offset=offset, at=at or 0.0, c=confidence or 0.0, hit=bool(hit), good=good, clear=bool(hit) and not ambiguous)
        pair = (min(a, b), max(a, b))
        if pair not in one or key < one[pair][0]:
            one[pair] = key, e
    edges = [e for _, e in one.values()]
    ref = next(c for c in clips if clips[c])
    got = {ref: (1.0, 0.0, 1.0, True, None)}

    def hang(e, frm, to):
        rate, shift = 1 + e["d"], e["offset"] - e["d"] * e["at"]
        if to == e["a"]:
            rate, shift = 1 / rate, -shift / rate
        r, s, c, sure, _ = got[frm]
        got[to] = r * rate, r * shift + s, min(c, e["c"]), sure and e["good"], frm

    while True:
        ways = [((ref not in (e["a"], e["b"])), -e["c"], min(e["a"], e["b"]), max(e["a"], e["b"])) + ((e["a"], e["b"]) if e["a"] in got else (e["b"], e["a"])) + (k,) for k, e in enumerate(edges) if e["good"] and (e["a"] in got) != (e["b"] in got)]
        if not ways:
            break
        *_, frm, to, k = min(ways)
        hang(edges[k], frm, to)
    for clip in sorted(c for c in clips if c not in got):
        ways = [(-e["c"], e["b"] if e["a"] == clip else e["a"], k) for k, e in enumerate(edges) if e["hit"] and clip in (e["a"], e["b"]) and (e["b"] if e["a"] == clip else e["a"]) in got]
        if ways:
            _, frm, k = min(ways)
            hang(edges[k], frm, clip)
    off = set()
    for e in edges:
        if e["clear"] and e["a"] in got and e["b"] in got and got[e["a"]][4] != e["b"] and got[e["b"]][4] != e["a"]:
            ra, sa, rb, sb = *got[e["a"]][:2], *got[e["b"]][:2]
            if abs(e["at"] + e["offset"] - (rb * e["at"] + sb - sa) / ra) > 0.010:
                off.add((e["a"], e["b"]))
    return got, off


def test_random_projects(spark):
    rng = random.Random(11)
    clips, edges = [], []
    for pr in range(200):
        names = [f"c{k:02}" for k in range(rng.randint(1, 14))]
        ref = rng.choice(names)
        clips += [(pr, n, n == ref, None) for n in names]
        true = {n: rng.randint(-50, 50) / 4 for n in names}
        for _ in range(rng.randint(0, 30)):
            a, b = rng.choice(names), rng.choice(names)
            offset = true[b] - true[a] + rng.choice([0, 0, 0, 0.004, 0.5])
            edges.append((pr, a, b, offset, rng.randint(0, 100) / 8, rng.choice([None, 100.0, -40.0]), rng.choice([True, False, None]), rng.choice([None, 0.5, rng.random(), rng.random()]), rng.choice([True, True, True, False, None]), rng.choice([True, False, False, None]), None))
        if pr % 5 == 0:
            edges += [(pr, None, names[0], 1.0, None, None, None, 1.0, True, False, None), (pr, names[0], "gone", 1.0, 0.0, None, None, 1.0, True, False, None), (pr, names[0], names[-1], None, 0.0, None, None, 1.0, True, False, None)]
    maps, off = trees.synchronised(spark.createDataFrame(clips, CLIPS).repartition(4), spark.createDataFrame(edges, EDGES).repartition(4), ["pr"])
    got, bad = {}, {}
    for r in maps.collect():
        got.setdefault(r.pr, {})[r.clip] = None if r.rate is None else (r.rate, r.shift, r.confidence, r.sure, r.via)
    for r in off.collect():
        bad.setdefault(r.pr, set()).add((r.a, r.b))
    late = 0
    for pr in range(200):
        own = {c: ref for p, c, ref, _ in clips if p == pr}
        want, disagree = plain(own, [e[1:10] for e in edges if e[0] == pr])
        assert set(got[pr]) == set(own)
        assert {c for c, v in got[pr].items() if v} == set(want), pr
        for c, (rate, shift, confidence, sure, via) in want.items():
            have = got[pr][c]
            assert have[2:] == (confidence, sure, via), (pr, c, have, want[c])
            assert abs(have[0] - rate) < 1e-12 and abs(have[1] - shift) < 1e-9
            late += not sure
        assert bad.get(pr, set()) == disagree, pr
    assert late > 10 and sum(map(len, bad.values())) > 10


def test_chain_and_empty(spark):
    """A chain takes as many steps as it has links, and chained drifts multiply."""
    names = [f"c{k}" for k in range(6)]
    clips = spark.createDataFrame([(None, n, n == "c5", None) for n in names] + [(1, "x", False, None)], CLIPS)
    edges = spark.createDataFrame([(None, names[k], names[k + 1], 2.0, 10.0, 100.0, True, 0.9 - k / 10, True, False, None) for k in range(5)], EDGES)
    maps, off = trees.synchronised(clips.where("pr is not null"), edges.where("pr is not null"), ["pr"])
    assert [tuple(r) for r in maps.collect()] == [(1, "x", None, None, None, None, None)] and off.count() == 0
    maps, off = trees.synchronised(clips.fillna({"pr": 0}), edges.fillna({"pr": 0}), ["pr"])
    first = next(r for r in maps.collect() if r.clip == "c0")
    assert abs(first.rate - (1 + 1e-4) ** -5) < 1e-12 and first.confidence == 0.5 and first.via == "c1" and off.count() == 0
    maps, off = trees.synchronised(clips.limit(0), edges.limit(0), ["pr"])
    assert maps.count() == 0 and off.count() == 0
