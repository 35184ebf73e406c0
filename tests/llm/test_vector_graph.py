"""Near duplicates among vectors against all pairs: groups within and across cells, odd rows, and the pruning rule."""

import numpy as np
import pytest

from chronoweave.llm import vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell int, home string, copies int, top long"


def table(spark, rows):
    """With columns named like those that the operator makes, half of them null."""
    return spark.createDataFrame([(i, v, l, None, 3, None, 4, None) for i, v, l in rows], SCHEMA)


def plain(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    x = [None if v is None or l is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(np.float32(v), float) for _, v, l in rows]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold * np.linalg.norm(x[a]) * np.linalg.norm(x[b]):
                n[a] += 1
                n[b] += 1
                root[top(a)] = top(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, n[k], least.get(top(k)), i is not None and i == least.get(top(k))) for k, (i, _, _) in enumerate(rows)), key=str)


def got(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def made():
    """Background, near copies of some, a dense group with a chain along an arc, and copies."""
    rng = np.random.default_rng(6)
    rows = []

    def add(v, label):
        rows.append((len(rows), np.float32(v).tolist(), label))

    for k in range(500):
        add(rng.normal(size=12) * 2.0 ** rng.integers(-30, 30), k % 2)
    for k in range(0, 60, 3):
        for _ in range(3):
            add(np.array(rows[k][1]) * (1 + rng.normal(size=12) * 0.05), rows[k][2])
    centre = rng.normal(size=12)
    for _ in range(150):
        add(centre + rng.normal(size=12) * 0.2, 0)
    for k in range(100):  # neighbours link, the ends of the arc are opposite
        add([np.cos(k * np.pi / 100), np.sin(k * np.pi / 100)] + [0.0] * 10, 1)
    for _ in range(40):
        add(rows[7][1], 1)
    return rows


@pytest.mark.parametrize("shape", [{}, {"shard": 60, "fan": 3, "per_pivot": 20}])
def test_against_all_pairs(spark, made, shape):
    df = table(spark, made).repartition(5)
    out = vector_graph.near_duplicates(df, **shape).persist()
    want, have = plain(made), got(out)
    assert [r[0] for r in have] == [r[0] for r in want]
    assert all(a[1] <= b[1] for a, b in zip(have, want))  # nothing below the threshold
    recall = sum(r[1] for r in have) / sum(r[1] for r in want)
    assert recall >= 0.99, recall
    assert sum(a[2] == b[2] for a, b in zip(have, want)) >= 0.99 * len(want)
    found, there = vector_graph.audit(df, out, queries=10_000)
    assert (found, there) == (sum(r[1] for r in have), sum(r[1] for r in want))
    out.unpersist()


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 1.0], 1), (5, [float("nan"), 1.0, 1.0], 1), (6, [float("inf"), 1.0, 1.0], 1), (7, v, None), (None, None, None),
        (10, v, 1), (11, v, 1), (11, v, 1), (None, v, 1), (12, [3e38, 3e38 * 2 / 3, 1.0], 1), (13, [2e38, 2e38 * 2 / 3, 1.0], 1), (14, v, 2), (15, v + [0.0], 1), (16, [-1.0, -2.0, -3.0], 1),
        (None, [5.0, -5.0, 0.1], 3), (None, [5.0, -5.0, 0.1], 3), (9, [1e-40, 2e-40, 3e-40], 1),
    ]
    assert got(vector_graph.near_duplicates(table(spark, rows))) == plain(rows)
    assert got(vector_graph.near_duplicates(table(spark, rows).limit(0))) == []
    assert vector_graph.audit(table(spark, []).limit(0), vector_graph.near_duplicates(table(spark, []).limit(0))) == (0, 0)


def test_threshold_is_met_exactly(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [3.0, 4.0], 1), (2, [0.0, 1.0], 1)]
    assert [r[1] for r in got(vector_graph.near_duplicates(table(spark, rows), threshold=0.6))] == [1, 2, 1]
    assert [r[1] for r in got(vector_graph.near_duplicates(table(spark, rows), threshold=0.6000001))] == [0, 1, 1]


def test_pruning_rule():
    """Each kept edge and each dropped candidate, by the rule in words."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tail, head = vector_graph.robust_prune(x, degree=4, candidates=20)
    edges = set(zip(tail.tolist(), head.tolist()))
    for p in range(80):
        far = np.sqrt(np.maximum(2 - 2 * x @ x[p], 0))
        kept = []
        for j in [j for j in np.argsort(far) if j != p][:20]:
            if len(kept) < 4 and all(1.2 * np.sqrt(max(2 - 2 * x[k] @ x[j], 0)) > far[j] for k in kept):
                kept.append(j)
        assert all((p, j) in edges for j in kept)
        assert all((j, p) in edges for j in kept[:2])
