"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Equal vectors are one class from the start. Spherical k-means on a bounded sample, from several starts, gives several
tables of centroids; in each, a class lives in the cell of its nearest centroid and is shown to the next nearest as a guest,
so that its copies are as many at every size. A cell's own vectors are multiplied with all it is shown, in blocks of bounded
size that different tasks work on; blocks return counts of links and a forest over what is linked, never pairs. A pair that
several tables show is counted in the first.

Defined results: vectors that ``usable`` leaves out link with nothing and are kept. Rows that repeat a vec_id are rows of
their own, linked if their vectors are. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut_lineage
from .components import connected_components
from .vectors import classes, matrix, sample, usable


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids; a cell that empties takes the vector that fits worst."""
    x = _unit(x)
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        fit = x @ centers.T
        home = fit.argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        worst = iter(np.argsort(fit.max(1)))
        for i in np.flatnonzero(size < 1e-9):
            sums[i] = x[next(worst)]
        centers = _unit(sums)
    return np.unique(centers, axis=0)


def _shown(rows: DataFrame, tables: list[np.ndarray], probes: int, kind: str) -> DataFrame:
    """(tab, cell, home, cid, n, v, seen): a class in its own cell of each table and, as a guest, in the next nearest.

    ``seen`` lists its cells, ``probes`` for each table, its own first.
    """
    of_kind = {"float": pa.float32(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.slice(s, 1024)
                x, seen = _unit(matrix(part["v"])), []
                for centers in tables:
                    fit = x @ centers.T
                    take = min(probes, fit.shape[1])
                    near = np.argpartition(-fit, take - 1, axis=1)[:, :take]
                    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(fit, near, 1), axis=1, kind="stable"), 1)
                    seen.append(np.pad(near, ((0, 0), (0, probes - take)), constant_values=-1))
                every = np.concatenate(seen, axis=1).astype(np.int32)
                ends = pa.array(np.arange(0, every.size + 1, every.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(every.ravel()))
                own = part["v"].cast(pa.list_(of_kind))
                for t, near in enumerate(seen):
                    for k in range(probes):
                        some = pa.array(np.flatnonzero(near[:, k] >= 0))
                        cell = pa.array(near[near[:, k] >= 0, k].astype(np.int32))
                        tab, home = pa.array(np.full(len(cell), t, np.int32)), pa.array(np.full(len(cell), k == 0))
                        rest = [c.take(some) for c in (part["cid"], part["n"], own, lists)]
                        yield pa.RecordBatch.from_arrays([tab, cell, home, *rest], names=["tab", "cell", "home", "cid", "n", "v", "seen"])

    schema = f"tab int, cell int, home boolean, cid long, n long, v array<{kind}>, seen array<int>"
    return rows.select("cid", "n", "v").mapInArrow(run, schema)


def _first_here(ids: np.ndarray, others: np.ndarray, left: np.ndarray, right: np.ndarray, tab: int, probes: int) -> np.ndarray:
    """Which pairs of vectors, each with its cells, are counted where the left one's home in table ``tab`` shows the right one.

    That is the first table in which either's home shows the other, and there the home of the smaller id, if it does.
    """
    early = np.zeros(len(ids), bool)
    for t in range(tab + 1):
        x, y = left[:, t * probes : (t + 1) * probes], right[:, t * probes : (t + 1) * probes]
        back = (x == y[:, :1]).any(1)
        if t < tab:
            early |= back | (y == x[:, :1]).any(1)
    return ~early & ((ids < others) | ~back)


def _links(left: pa.Table, right: pa.Table, at_least: float, probes: int) -> pa.Table:
    """(a, b, links): for each vector linked here, the least of its group here, and how many rows it links with.

    A pair is met in several tables; its rows count where ``_first_here`` says.
    """
    names = ["a", "b", "links"]
    if not len(left) or not len(right):
        return pa.table([pa.array([], pa.int64())] * 3, names=names)
    tab = left["lt"][0].as_py()
    ids, others, m, n = left["cid"].to_numpy(), right["cid"].to_numpy(), left["n"].to_numpy(), right["n"].to_numpy()
    x, y = _unit(matrix(left["v"]).astype(np.float64)), _unit(matrix(right["v"]).astype(np.float64))
    own, guest = matrix(left["seen"]), matrix(right["seen"])
    near = x.astype(np.float32) @ y.astype(np.float32).T >= at_least - 1e-4
    links, back = np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64)
    r, c = np.nonzero(near)
    for s in range(0, len(r), 100_000):
        i, j = r[s : s + 100_000], c[s : s + 100_000]
        near[i, j] = linked = (np.einsum("ij,ij->i", x[i], y[j]) >= at_least) & (ids[i] != others[j])
        i, j = i[linked], j[linked]
        here = _first_here(ids[i], others[j], own[i], guest[j], tab, probes)
        np.add.at(links, i[here], n[j[here]])
        np.add.at(back, j[here], m[i[here]])
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    near = near[np.ix_(rows, cols)]
    a, b, top = ids[rows], others[cols], np.iinfo(np.int64).max
    while near.size:  # the least id spreads over the block until it rests
        low = np.minimum(a, np.where(near, b[None, :], top).min(1))
        high = np.minimum(b, np.where(near, low[:, None], top).min(0))
        if (low == a).all() and (high == b).all():
            break
        a, b = low, high
    ends = [np.concatenate(z) for z in ((ids[rows], others[cols]), (a, b), (links[rows], back[cols]))]
    return pa.table([pa.array(z.astype(np.int64)) for z in ends], names=names)


def dedup_vectors(
    vectors: DataFrame,
    at_least: float = 0.95,
    tables: int = 4,
    probes: int = 2,
    cells: int | None = None,
    block_rows: int = 2048,
    sample_rows: int = 10_000,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    ``cells`` of each table: one for 500 vectors up to 4096 and from then on a quarter of the root of their number; the sample
    on the driver has ``sample_rows`` vectors, or 4 a cell. Each vector has ``tables`` times ``probes`` copies at every size. Of pairs at a cosine of 0.95 among random vectors of 64 dimensions, those that no table
    shows to each other are 1 in 10,000 with 64 cells a table, 1 in 1,400 with 256 and 1 in 550 with 1024, and fewer of more
    similar pairs; more ``tables`` or ``probes`` find more. Vectors of one group are mostly found by way of others, too.
    """
    rows = usable(vectors)
    # Floats go round as floats, which loses nothing and halves the shuffle.
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    every = cut_lineage(classes(rows))
    count = every.count()
    keys = ["c1", "c2"]
    if count:
        many = cells or max(1, min(4096, count // 500), round(math.sqrt(count) / 4))
        fit = sample(every, count, max(sample_rows, 4 * many))
        centers = [spherical_kmeans(fit, many, seed=3 + t) for t in range(tables if many > 1 else 1)]
        shown, at = _shown(every, centers, probes, kind), ["tab", "cell"]
        held = shown.groupBy(*at).agg(F.count_if("home").alias("own"), F.count(F.lit(1)).alias("all")).collect()
        sizes = [(r.tab, r.cell, math.ceil(max(r.own, 1) / block_rows), math.ceil(r["all"] / block_rows)) for r in held]
        size = vectors.sparkSession.createDataFrame(sizes, "tab int, cell int, lefts int, rights int")
        shown = shown.join(F.broadcast(size), at)  # one row per centroid
        deal = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
        every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = shown.where("home").withColumn("i", deal("lefts", 1)).withColumn("j", every_of("rights"))
        right = shown.withColumn("j", deal("rights", 2)).withColumn("i", every_of("lefts"))
        names = {"tab": "lt", "cell": "lc", "i": "li", "j": "lj"} | {c: c for c in ("cid", "n", "v", "seen")}
        left = left.select(*[F.col(c).alias(new) for c, new in names.items()])
        right = right.drop("home", "lefts", "rights")
        pairs = left.groupBy("lt", "lc", "li", "lj").cogroup(right.groupBy(*at, "i", "j"))
        linked = cut_lineage(pairs.applyInArrow(lambda x, y: _links(x, y, at_least, probes), "a long, b long, links long"))
        groups = connected_components(linked.select("a", "b"))
        links = linked.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
        info = every.select("cid", "n", *keys).join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
        info = info.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    else:
        info = every.select(*keys, F.lit(0).cast("long").alias("n_links"), F.col("cid").alias("component_id"))
    known = rows.select("vec_id", *keys).join(info, keys).drop(*keys)
    return known.unionByName(_aside(vectors, rows)).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _aside(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """The vectors that take no part."""
    good = rows.select(F.col("vec_id").alias("__good")).distinct()
    out = vectors.select(F.col("vec_id").cast("long")).join(good, F.col("vec_id") == F.col("__good"), "left_anti")
    return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))


def digest(vectors: DataFrame) -> DataFrame:
    return dedup_vectors(vectors)
