"""Links between vectors against brute force: planted pairs just above the threshold, several tables of cells, hot groups."""

import numpy as np
import pytest

from tessera.llm import embed_dedup


def planted(n, pairs, cos, seed=1, dims=64, groups=0):
    """Random unit vectors; the last ``pairs`` each at a cosine of ``cos`` from one of the others; around groups if asked."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    if groups:
        x = x * 0.35 + rng.standard_normal((groups, dims))[rng.integers(0, groups, n)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k, o in enumerate(rng.choice(n - pairs, pairs, replace=False)):
        side = rng.standard_normal(dims)
        side -= (side @ x[o]) * x[o]
        x[n - pairs + k] = cos * x[o] + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side)
    return x


def brute(x, at_least=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    found = []
    for s in range(0, len(u), 1000):
        r, c = np.nonzero(u[s : s + 1000] @ u.T >= at_least)
        found += [(int(a) + s, int(b)) for a, b in zip(r, c) if a + s != b]
    return found


@pytest.mark.parametrize(("n", "cells", "groups"), [(4_000, 64, 0), (4_000, 200, 0), (6_000, None, 0), (4_000, 64, 20)])
def test_pairs_at_the_threshold(spark, n, cells, groups):
    x = planted(n, 400, 0.951, groups=groups)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in embed_dedup.dedup_vectors(df, cells=cells).collect()}
    want = np.bincount([a for a, _ in brute(x)], minlength=n)
    got = np.array([out[i].n_links for i in range(n)])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() >= 800
    assert all(out[b].component_id <= b for b in out)


def test_hot_group_counts_every_link(spark):
    """A third of all vectors are near copies of one, in many blocks: each pair is counted once, whatever tables show it."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 32))
    x[::3] = x[0] + rng.standard_normal((300, 32)) * 0.02
    x[1::90] = x[2]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in embed_dedup.dedup_vectors(df, cells=12, block_rows=64).collect()}
    want = np.bincount([a for a, _ in brute(x)], minlength=900)
    assert [out[i].n_links for i in range(900)] == want.tolist()
    assert {out[i].component_id for i in range(0, 900, 3)} == {0}
