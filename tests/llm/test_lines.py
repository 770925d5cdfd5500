"""Line dedup in batches, and documents added later."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup


def texts(n, seed=1):
    """Documents of shared and of own lines; the first line is in a third of them."""
    rng, shared = np.random.default_rng(seed), [f"a shared line, number {i}, of more than forty characters" for i in range(30)]
    out = []
    for i in range(n):
        lines = [f"  {shared[j].upper() if rng.random() < 0.5 else shared[j]}\t" for j in rng.integers(1, 30, rng.integers(0, 4))]
        lines += [shared[0]] * int(i % 3 == 0) + [f"a line of its own, of document {i}, of forty characters", "short"]
        out.append((int(rng.integers(0, 10**6)) * 1000 + i, "\n".join(rng.permutation(lines))))
    return out


def brute(rows, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    docs = defaultdict(set)
    for doc, text in rows:
        for line in text.split("\n"):
            docs[key(line)].add(doc)
    gone = {k: max(v) for k, v in docs.items() if len(k) >= 40 and len(v) >= min_docs}
    keep = lambda doc, line: gone.get(key(line), doc) == doc
    return {doc: "\n".join(x for x in text.split("\n") if keep(doc, x)) for doc, text in rows}


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (2, 4), (5, 2)])
def test_batches_agree_with_brute_force(spark, batches, fanout):
    rows = texts(240)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fanout=fanout)
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)


def test_documents_added_later(spark):
    """Two deliveries, the second without reading the first again, give what one run over all gives."""
    rows = texts(240)
    early, late = rows[:150], rows[150:]
    index = line_dedup.LineIndex(fanout=2)
    schema = "doc_id long, text string"
    index.add(spark.createDataFrame(early, schema), batches=3)
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(early, schema), index).collect()} == brute(early)
    index.add(spark.createDataFrame(late, schema))
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, schema), index).collect()} == brute(rows)


def test_runs_are_compacted(spark):
    runs = line_dedup.SortedRuns(fanout=2)
    for b in range(4):
        runs.add(spark.createDataFrame([(b, 1, 1), (b, 2, b)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted(map(tuple, runs.merged().collect())) == [(1, 1, 4, 3), *[(2, b, 1, b) for b in range(4)]]


def test_many_keys_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEND_KEYS", 0)
    rows = texts(120)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=2)
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)


def test_odd_rows(spark):
    line = "a line that several documents hold, word for word"
    rows = [(i, line, "x") for i in range(5)] + [(4, line, "x"), (4, f"{line}\n" * 2, "x"), (None, line, "x"), (7, None, None), (8, "", "x"), (9, "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __dropped string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(rows)
    by = sorted(((r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "") for r in out.where("doc_id IS NULL OR doc_id <> 9").collect()))
    want = [(0, ""), (1, ""), (2, ""), (3, ""), (4, line), (4, line), (4, f"{line}\n{line}\n"), (7, None), (8, ""), (None, line)]
    assert by == sorted((d is None, d or 0, t is not None, t or "") for d, t in want)
    digest = line_dedup.digest(df).where(F.col("doc_id") == 7).first()
    assert (digest.n_lines, digest.n_dropped, digest.kept_sha256) == (1, 0, hashlib.sha256(b"").hexdigest())
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
