"""Line deduplication with levelled sorted runs of line hashes.

Lines enter in batches. The keys of a batch become one sorted run (key, documents, largest document), which is joined with
the runs that stand already: what is new there survives, and of the rest every line is a repeat but that of the largest
document so far; where the batch holds a larger one, the line of the earlier holder becomes a repeat. Then the run is added;
when a level holds ``fanout`` runs they are merged into one run of the next level, so a key sits in few runs however many
batches came. Repeats are lost once enough documents hold their key. Later batches need the runs and the repeats, never the
earlier documents. A key that very many documents hold is one row of a run; its lines are never gathered in one task.

Defined results: a null or empty text is one empty line, which is never a candidate while ``min_chars`` > 0. Rows that
share a ``doc_id`` count as one document and all keep what the largest document keeps; rows with a null ``doc_id`` keep
all their lines and are not counted. Columns other than ``doc_id`` and ``text`` pass through ``dedup_lines`` untouched,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, cut_lineage, free

KEYS = ["h1", "h2"]
#: Above so many keys (24 bytes each), they are joined by a shuffle instead of being sent to every task.
SEND_KEYS = 200_000


def _key(line: str, min_chars: int) -> bytes | None:
    line = line.strip(SPACE)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= min_chars else None


def _halves(keys: Iterable[bytes]) -> list[pa.Array]:
    both = pa.py_buffer(b"".join(keys))
    whole = pa.Array.from_buffers(pa.int64(), len(both) // 8, [None, both])
    return [whole.take(pa.array(range(i, len(whole), 2), pa.int64())) for i in (0, 1)]


def line_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, h1, h2): each distinct line key of at least ``min_chars`` code points, once per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                found = {_key(line, min_chars) for line in (text.as_py() or "").split("\n")} - {None}
                ids += [doc] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *_halves(keys)], names=["doc_id", *KEYS])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long")


class SortedRuns:
    """Levels of sorted runs (h1, h2, documents, holder): how many documents hold a key, and the largest of them.

    All runs are dealt by key to the same number of tasks and sorted there, so that they are merged and joined in place.
    """

    def __init__(self, fanout: int = 4):
        self.fanout, self.levels = fanout, [[]]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of ``line_keys`` of documents not seen before; what is returned are the lines it makes repeats.

        (doc_id, h1, h2): lines whose key a larger document of this batch or of the standing runs holds, and the lines
        of earlier holders that this batch has a larger document for.
        """
        held = lines.groupBy(*KEYS, "doc_id").agg(F.lit(1).alias("one"))  # rows of one doc_id are one document
        own = self._run(held.groupBy(*KEYS).agg(F.count("one").alias("documents"), F.max("doc_id").alias("holder")))
        known = own.withColumn("was", F.lit(None).cast("long"))
        if self.runs():
            known = own.join(self.merged().select(*KEYS, F.col("holder").alias("was")).hint("merge"), KEYS, "left")
        # The keys that the anti-join does not let pass as new.
        shared = cut_lineage(known.where("documents > 1 OR was IS NOT NULL").withColumn("holder", F.greatest("holder", "was")))
        again = _meet(lines, shared.select(*KEYS, "holder")).where("doc_id <> holder").select("doc_id", *KEYS)
        beaten = shared.where("was < holder").select(F.col("was").alias("doc_id"), *KEYS)
        repeats = cut_lineage(again.unionAll(beaten))
        self.levels[0].append(own)
        self._compact()
        return repeats

    def _run(self, rows: DataFrame) -> DataFrame:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cut_lineage(rows.repartition(tasks, *KEYS).sortWithinPartitions(*KEYS), dealt=True)

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._run(_merged(runs)))
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame:
        runs = self.runs()
        return runs[0] if len(runs) == 1 else _merged(runs)


def _merged(runs: list[DataFrame]) -> DataFrame:
    union = runs[0]
    for run in runs[1:]:
        union = union.unionAll(run)
    return union.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.max("holder").alias("holder"))


def _meet(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``lines`` with a key of ``keys``: few keys go to every task, more are joined by a shuffle that splits hot keys."""
    few = keys.limit(SEND_KEYS + 1).count() <= SEND_KEYS
    return lines.join(F.broadcast(keys) if few else keys, KEYS)


class LineIndex:
    """What line dedup knows of the documents it has seen: sorted runs, and the lines that are repeats so far."""

    def __init__(self, min_chars: int = 40, min_docs: int = 5, fanout: int = 4):
        self.min_chars, self.min_docs, self.runs, self.repeats = min_chars, min_docs, SortedRuns(fanout), []

    def add(self, docs: DataFrame, batches: int = 1) -> None:
        """Take in documents whose doc_ids were not seen before, as so many batches; their texts are read once."""
        lines = line_keys(docs, self.min_chars)
        if batches > 1:
            lines = cut_lineage(lines)
        for b in range(batches):
            part = lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b) if batches > 1 else lines
            self.repeats.append(self.runs.add(part))

    def lost(self) -> DataFrame:
        """(doc_id, dropped array<struct<h1,h2>>): the line keys that each document loses, as of now."""
        often = self.runs.merged().where(F.col("documents") >= self.min_docs).select(*KEYS)
        repeats = self.repeats[0]
        for more in self.repeats[1:]:
            repeats = repeats.unionAll(more)
        lost = _meet(repeats, cut_lineage(often)).groupBy("doc_id", *KEYS).agg(F.lit(1).alias("one"))
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEYS)).alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, counts: bool = False) -> DataFrame:
    """``docs`` with the surviving lines as its text (no text stays no text); ``counts`` adds n_lines and n_dropped.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines but those
    of the largest ``doc_id`` holding them.
    """
    index = LineIndex(min_chars, min_docs, fanout)
    index.add(docs, batches)
    return drop_lines(docs, index, counts)


def drop_lines(docs: DataFrame, index: LineIndex, counts: bool = False) -> DataFrame:
    """``docs``, all seen by ``index``, with the lines that survive there."""
    min_chars = index.min_chars
    doc, dropped, cut, n_lines = (free(docs, n) for n in ("__doc", "__dropped", "__cut", "__n_lines"))
    lost = index.lost().select(F.col("doc_id").alias(doc), F.col("dropped").alias(dropped))
    rows = docs.join(lost, F.col("doc_id") == F.col(doc), "left")
    hit = F.col(dropped).isNotNull() & F.col("text").isNotNull()
    # Python gets the text only of rows that lose a line.
    rows = rows.withColumn(n_lines, F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(1)).cast("long"))
    rows = rows.withColumn(cut, _cutter(min_chars)(F.when(hit, F.col("text")), F.col(dropped)))
    text = F.when(hit, F.col(f"{cut}.text")).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n_dropped = F.coalesce(F.col(f"{cut}.n_dropped"), F.lit(0)).cast("long")
        columns += [F.col(n_lines).alias("n_lines"), n_dropped.alias("n_dropped")]
    return rows.select(*columns)


def _cutter(min_chars: int):
    @F.pandas_udf("text string, n_dropped long")
    def cut(texts, dropped):
        import pandas as pd

        rows = []
        for text, keys in zip(texts, dropped):
            if text is None:
                rows.append((None, 0))
                continue
            lines = text.split("\n")
            gone = {h["h1"].to_bytes(8, "little", signed=True) + h["h2"].to_bytes(8, "little", signed=True) for h in keys}
            kept = [x for x in lines if _key(x, min_chars) not in gone]
            rows.append(("\n".join(kept), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_dropped"])

    return cut


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = dedup_lines(docs.select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
