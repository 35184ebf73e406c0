"""The tree over count vectors against all pairs."""

import numpy as np
import pytest

from chronoweave.llm import ngram_join


@pytest.mark.parametrize("seed", range(12))
def test_tree_pairs(seed):
    rng = np.random.default_rng(seed)
    m, d = int(rng.choice([1, 2, 33, 300, 900])), int(rng.choice([4, 32, 128]))
    base = rng.integers(0, 6, (max(1, m // 7), d))
    vec = np.maximum(0, base[rng.integers(0, len(base), m)] + rng.integers(-1, 2, (m, d)) * (rng.random((m, d)) < rng.choice([0.02, 0.2]))).astype(np.uint8)
    n = vec.sum(1, dtype=np.int64) + rng.integers(0, 3, m)
    comp, node = rng.integers(0, rng.choice([1, 3, m + 1]), m), rng.permutation(m * 3)[:m].astype(np.int64)
    side = rng.integers(0, 2, m) if seed % 3 == 0 else None
    x, y = ngram_join.tree_pairs(node, comp, n, vec, 85, side)
    got = list(zip(x.tolist(), y.tolist()))
    a, b = np.triu_indices(m, 1)
    bound = np.array([np.minimum(vec[i], vec[j]).sum(dtype=np.int64) for i, j in zip(a, b)], dtype=np.int64) if m > 1 else np.zeros(0, np.int64)
    beyond = n - vec.sum(1, dtype=np.int64)
    fits = (bound + np.minimum(beyond[a], beyond[b]) >= ngram_join.least_overlap(n[a], n[b], 85)) & (comp[a] != comp[b])
    if side is not None:
        fits &= side[a] != side[b]
    # Sizes too far apart are pruned at the boxes already.
    near = 85 * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b])
    want = {tuple(sorted((int(node[i]), int(node[j])))) for i, j in zip(a[fits & near], b[fits & near])}
    all_fit = {tuple(sorted((int(node[i]), int(node[j])))) for i, j in zip(a[fits], b[fits])}
    assert len(got) == len(set(got)) and want <= set(got) <= all_fit
