"""Nearest vectors of tables of every size against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def brute(ids, vectors, queries, k):
    """Rows (query, rank, id, score): candidates are all rows but the query's own."""
    out = []
    for q in queries:
        score = vectors @ vectors[q]
        others = [i for i in range(len(ids)) if i != q]
        order = sorted(others, key=lambda i: (-score[i], ids[i]))[:k]
        out += [(ids[q], r + 1, ids[i], score[i]) for r, i in enumerate(order)]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 10, 21, 25, 50, 100, 200, 500])
def test_small_tables_are_exact(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 16)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    found = ann.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute(list(range(n)), x.astype(float), range(0, n, 20), 20)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [w[:3] for w in want]
    assert np.allclose([r.score for r in sorted(found)], [w[3] for w in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("n", [2_000, 6_000])
def test_larger_tables(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 32)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.nearest(rows, F.col("vec_id") % 100 == 0).collect()
    want = {w[0::2][:2] for w in brute(list(range(n)), x.astype(float), range(0, n, 100), 20)}
    assert len(found) == len(want) and len(want & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(want)


def test_ties_and_repeated_ids(spark):
    """Equal scores go by vec_id; a row that repeats the query's id and vector is a candidate once."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [0.5, 1.0]), (5, [0.5, -1.0]), (9, None), (None, [1.0, 0.0])]
    found = ann.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(0, 0, 1.0), (0, 3, 1.0), (0, 7, 1.0), (0, 5, 0.5), (0, 5, 0.5)]


def test_one_hot_vector(spark):
    """A third of all rows are equal: each query gets the least ids of them."""
    x = np.random.default_rng(5).standard_normal((900, 8)).astype(np.float32)
    x[::3] = x[1] * 3
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.digest(rows).collect()
    want = brute(list(range(900)), x.astype(float), range(0, 900, 20), 20)
    assert sum((r.query_id, r.vec_id) in {w[0::2][:2] for w in want} for r in found) >= 0.98 * len(want) and len(found) == len(want)
