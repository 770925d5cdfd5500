"""What the vector operators share: which vectors take part, classes of equal vectors, and a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, c1, c2) of the vectors that take part; c1 and c2 are equal for equal vectors.

    Null, empty and zero vectors, those with a null or non-finite component, and those of another length than most
    (ties: the shorter) take no part, nor do rows without a vec_id.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = sorted(rows.groupBy(F.size("v").alias("n")).count().collect(), key=lambda r: (-r["count"], r["n"]))
    rows = rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))
    return rows.select("vec_id", "v", F.xxhash64("v").alias("c1"), F.xxhash64(F.lit("second"), "v").alias("c2"))


def classes(rows: DataFrame, keep: int = 1) -> DataFrame:
    """One row per different vector: (cid, n, v, c1, c2); cid is its least vec_id, n its number of rows."""
    return rows.groupBy("c1", "c2").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))


def members(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, vec_id, nth): the ``keep`` least vec_ids of each class; Spark limits each task's rows before the shuffle.

    ``nth`` numbers rows of equal vec_id and vector from 1.
    """
    w = Window.partitionBy("c1", "c2").orderBy("vec_id")
    ranked = rows.select("c1", "c2", "vec_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    nth = F.row_number().over(Window.partitionBy("c1", "c2", "vec_id").orderBy("r"))
    return ranked.withColumn("cid", F.min("vec_id").over(w)).withColumn("nth", nth).select("cid", "vec_id", "nth")


def sample(rows: DataFrame, count: int, most: int) -> np.ndarray:
    """At most about ``most`` vectors, chosen by a hash of their id, as a matrix on the driver."""
    share = min(1.0, most / max(count, 1))
    picked = rows.where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).select("cid", "v").limit(2 * most)
    found = sorted(picked.collect())
    return np.array([r.v for r in found], np.float64).reshape(len(found), -1)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array<double> column as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
