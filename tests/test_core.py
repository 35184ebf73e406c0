"""Window formulations against naive loops, and the sequential ones on small cases."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from chronoweave.operators import intervals, matching, sets, similarity


def test_merge_and_hysteresis_match_loops(spark):
    rng = random.Random(3)
    rows = [(g, a := rng.randint(0, 60), a + rng.randint(0, 9)) for g in range(8) for _ in range(12)]
    got = sorted(map(tuple, intervals.merge(spark.createDataFrame(rows, "g int, s int, e int"), ["g"], "s", "e", 2).select("g", "s", "e").collect()))
    want = []
    for g in range(8):
        out = []
        for a, b in sorted((s, e) for k, s, e in rows if k == g):
            if out and a - out[-1][1] <= 2:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want += [(g, a, b) for a, b in out]
    assert got == sorted(want)
    xs = [rng.random() for _ in range(300)]
    state, expect = False, []
    for x in xs:
        state = True if x > 0.7 else False if x <= 0.3 else state
        expect.append(state)
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "g int, i int, x double")
    assert [r.active for r in intervals.hysteresis(df, ["g"], ["i"], "x", 0.7, 0.3).orderBy("i").collect()] == expect


def test_islands_boundaries_and_empty(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in [(0, 1), (1, 1), (2, 0), (3, 1), (6, 0), (9, 1), (10, 1)]], "g int, t int, v int")
    got = sorted((r.start, r.end, r.n) for r in intervals.islands(df, ["g"], "t", F.col("v") == 1, 1, 2, 0).collect())
    assert got == [(0, 4, 3), (9, 11, 2)]
    assert intervals.islands(df.limit(0), ["g"], "t", F.col("v") == 1).count() == 0


def test_nearest_and_intervals(spark):
    a = spark.createDataFrame([(1, 10), (1, 50), (2, 5)], "g int, t int")
    b = spark.createDataFrame([(1, 8, "x"), (1, 12, "y"), (1, 49, "z")], "g int, t int, v string")
    got = {(r.g, r.t): r.match and r.match.v for r in matching.nearest(a, b, ["g"], "t", ["v"], 3).collect()}
    assert got == {(1, 10): "x", (1, 50): "z", (2, 5): None}
    i = spark.createDataFrame([(1, 0, 100), (1, 10, 10)], "g int, a int, z int")
    assert matching.points_in_intervals(a, i, ["g"], "t", "a", "z", 7).count() == 3


def test_average_linkage_takes_the_nearest_pair(spark):
    def plain(x, limit):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        d, groups = 1 - unit @ unit.T, [[i] for i in range(len(x))]
        while len(groups) > 1:
            best, a, b = min((np.mean([d[i, j] for i in g for j in h]), k, m) for k, g in enumerate(groups) for m, h in enumerate(groups) if k < m)
            if best > limit:
                break
            groups[a] += groups.pop(b)
        return sorted(sorted(g) for g in groups)

    rng = np.random.Generator(np.random.PCG64(3))
    for n in (1, 2, 5, 30):
        for limit in (0.05, 0.3, 0.7, 1.5):
            x = rng.normal(size=(n, 3))
            found = similarity.average_linkage(x, limit)
            assert sorted([i for i in range(n) if found[i] == c] for c in set(found.tolist())) == plain(x, limit)
            assert found[0] == 0
    rows = [(1, i, [1.0, 0.01 * (i % 7)] if i // 4 % 2 else [0.01 * (i % 5), 1.0]) for i in range(40)] + [(2, 0, [1.0, 1.0]), (2, 1, None)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>")
    for most in (1500, 10):
        got = {(r.g, r.i): r.cluster for r in similarity.grouped(df, ["g"], "i", "v", 0.5, most).collect()}
        assert [got[1, i] for i in range(40)] == [i // 4 % 2 for i in range(40)] and got[2, 0] == 0 and got[2, 1] is None


def test_one_per_key_and_resolution(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string")
    assert sets.one_per_key(df, ["k"], F.col("o")).first().v == "x"
    assert sets.one_per_key(df, ["k"], F.col("o"), last=True).first().v == "y"
    wanted, known = spark.createDataFrame([("7",), ("12",)], "key string"), spark.createDataFrame([("IMG_7",), ("x12",), ("y12",)], "name string")
    got = {r.key: (r.name, r.candidates) for r in matching.resolve_keys(wanted, known, "key", "name").collect()}
    assert got == {"7": ("IMG_7", 1), "12": ("x12", 2)}


def test_entry_without_llm():
    """The entry imports and has its other queries with the subpackage and the pipeline hidden, but doesn't hide other missing modules."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in %s:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert not [q for q in e.queries() if q == "pipeline" or q.startswith("op")] and len(e.queries()) > 100
assert set(e.oracle_sql()) <= set(e.queries())
"""
    run = lambda names: subprocess.run([sys.executable, "-c", code % (names,)], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert run(("chronoweave.llm", "corpus_pipeline")).returncode == 0
    assert "ModuleNotFoundError" in run(("ahocorasick",)).stderr or not (Path(__file__).parent / "llm").exists()
