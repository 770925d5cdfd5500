"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The white space of every word and line rule here, as characters.
SPACE = " \t\n\x0b\x0c\r"
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut_lineage(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder, where a lost executor cannot take it along.

    Meanwhile Python workers get batches of at most ``BATCH_ROWS`` rows, which bounds what they hold of long texts. With
    ``dealt`` Spark goes on knowing how the rows are dealt and sorted: it forgets that of plans it adapts while they run.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    settings = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)}
    if dealt:
        settings["spark__sql__adaptive__enabled"] = "false"
    with _set(spark, **settings):
        # Plans are made when they are first needed, so this one must be new.
        return (df.select("*") if dealt else df).checkpoint(eager=True)


def pieces(column: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about ``limit`` bytes each, so that scratch arrays stay small.

    A single longer text is a range of its own: no text is cut.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
