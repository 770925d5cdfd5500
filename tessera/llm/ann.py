"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions along several random frames and ordered along one shifted Hilbert curve per
frame. Splitters from a bounded sample cut each curve into blocks of equal share; a query meets the vectors of its own
block and of the ``reach`` blocks to either side, on every curve. Each block returns its best for each query; the lists
are merged and reranked by the exact inner product in double precision.

The share of the table that a window spans, (2 * reach + 1) / blocks, decides recall; a block holds at least
``block_rows`` different vectors, so that smaller tables have fewer blocks, and one alone is searched whole. Large blocks
are dealt to parts of about ``part_rows`` rows, so no task holds more than that many vectors or queries at once.

Defined results: vectors that ``usable`` leaves out are neither queries nor candidates. Equal vectors are searched as
one class, of which as many least ids as the result can hold come back; ties go to the smaller vec_id. Rows that repeat a
vec_id are candidates of their own and one query, that of their largest vector in array order, whose row alone is no
candidate. Fewer candidates than ``k``: all of them. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut_lineage
from .vectors import classes, matrix, members, sample, usable


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer points (one per row, ``bits`` bits a dimension) along the Hilbert curve."""
    x = cells.T.astype(np.uint64)
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of each level, from the largest cells down
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint64(1 << b), np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


class Curves:
    """Random frames and shifts, scaled by a bounded sample, with the splitters of each curve's blocks."""

    def __init__(self, fit: np.ndarray, curves: int, dims: int, bits: int, blocks: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits, width = bits, fit.shape[1]
        self.frames = [np.linalg.qr(rng.standard_normal((width, width)))[0][:, : min(dims, width)] for _ in range(curves)]
        spread = [np.quantile(fit @ f, (0.001, 0.999), axis=0) for f in self.frames]
        self.low = [s[0] for s in spread]
        self.span = [np.maximum(s[1] - s[0], 1e-12) for s in spread]
        self.shifts = [rng.uniform(0, 0.5, f.shape[1]) for f in self.frames]
        self.splits = [np.quantile(self.keys(fit, c), np.arange(1, blocks) / blocks, method="nearest") for c in range(curves)]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        at = (vectors @ self.frames[curve] - self.low[curve]) / self.span[curve] / 2 + self.shifts[curve]
        return hilbert(np.clip(at * (1 << self.bits), 0, (1 << self.bits) - 1), self.bits)

    def blocks(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(s, self.keys(vectors, c), side="right") for c, s in enumerate(self.splits)]


def _dealt(rows: DataFrame, index: Curves) -> DataFrame:
    """(curve, block, cid, v): each vector once per curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                for c, at in enumerate(index.blocks(matrix(batch["v"]))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), c, np.int32)), pa.array(at.astype(np.int32)), batch["cid"], batch["v"]], names=["curve", "block", "cid", "v"])

    return rows.select("cid", "v").mapInArrow(run, "curve int, block int, cid long, v array<double>")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    curves: int = 12,
    dims: int = 6,
    bits: int = 6,
    blocks: int = 20,
    reach: int = 1,
    block_rows: int = 256,
    part_rows: int = 8192,
    sample_rows: int = 10_000,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each row that ``is_query`` picks."""
    rows = usable(vectors)
    every = cut_lineage(classes(rows).drop("c1", "c2"))
    count = every.count()
    blocks = max(1, min(blocks, count // max(block_rows, k + 1)))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.max(F.struct("v", "c1", "c2")).alias("x")).select("vec_id", "x.c1", "x.c2")
    n_asked = asked.count()
    spark = vectors.sparkSession
    if not count or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Curves(sample(every, count, sample_rows), curves, dims, bits, blocks, seed)
    ids = members(rows, k + 1)  # one more than the result holds: the query's own drops out
    parts = math.ceil(count / blocks / part_rows)
    shares = math.ceil(n_asked * (2 * reach + 1) / blocks / part_rows)

    of = asked.select(F.col("vec_id").alias("query_id"), "c1", "c2").join(rows.groupBy("c1", "c2").agg(F.min("vec_id").alias("cid")), ["c1", "c2"])
    of = cut_lineage(of.select("query_id", "cid"))
    queries = every.join(of.select("cid").distinct(), "cid", "left_semi")
    near = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1))))
    asks = _dealt(queries, index).withColumn("block", near).withColumn("share", F.pmod(F.xxhash64("cid"), F.lit(shares)).cast("int"))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    holds = _dealt(every, index).withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int"))
    holds = holds.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    window, take = ["curve", "block", "part", "share"], k + 1

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["q", "cid", "score"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        q, ids_q = matrix(left["v"]), left["cid"].to_numpy()
        order = np.argsort(right["cid"].to_numpy(), kind="stable")
        ids_c, c = right["cid"].to_numpy()[order], matrix(right["v"])[order]
        out = []
        for s in range(0, len(q), 512):
            score = q[s : s + 512] @ c.T
            top = np.argsort(-score, axis=1, kind="stable")[:, :take] if score.shape[1] <= 4 * take else _top(score, take)
            out.append((np.repeat(ids_q[s : s + 512], top.shape[1]), ids_c[top].ravel(), np.take_along_axis(score, top, 1).ravel()))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

    found = asks.groupBy(*window).cogroup(holds.groupBy(*window)).applyInArrow(best, "q long, cid long, score double")
    found = found.groupBy("q", "cid").agg(F.max("score").alias("score"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= take).drop("r")
    pairs = found.join(of.select("query_id", F.col("cid").alias("q")), "q")
    pairs = pairs.join(ids, "cid").where("NOT (q = cid AND vec_id = query_id AND nth = 1)")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(score: np.ndarray, take: int) -> np.ndarray:
    """Columns of the ``take`` largest of each row; of equal scores the first columns."""
    edge = -np.partition(-score, take - 1, axis=1)[:, take - 1 : take]
    rows, cols = np.nonzero(score >= edge)
    order = np.lexsort((cols, -score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    start = np.searchsorted(rows, np.arange(len(score)))
    return cols[start[:, None] + np.arange(take)]


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's search: every row whose vec_id is divisible by 20, against all rows."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
