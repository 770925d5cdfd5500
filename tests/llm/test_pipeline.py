"""The corpus pipeline, stage by stage and whole, on odd documents."""

import importlib
from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")
pipeline = importlib.import_module("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "this line is in very many documents and more than forty characters long"


def sentence(i):
    return " ".join(f"{w}{(i * k) % 97}" for k, w in enumerate("the quick brown fox jumps over one lazy dog while seven others watch it from afar".split(), 1))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{sentence(i)}\n{LINE}\n{sentence(i + 500)}", "en", f"s{i % 3}" if i % 7 else None, 9) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(LINE, "").replace("fox", "cat", 0), "en", "s1", 9) for i in range(5)]  # exact copies once the line has gone
    rows += [(200, None, "en", "s0", 0), (201, "", None, None, 0), (202, "12 % -- 34", None, "s1", 0), (203, "word " * 20_000, "en", "s2", 0), (204, "漢字 " * 30, None, "s0", 0)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"] and pipeline.ORACLE_SQL is None


def test_languages(spark, docs):
    out = stage("language_id")(spark, docs, "")
    assert out.columns == docs.columns and docs.count() - out.count() == 4
    assert out.where("doc_id IN (200, 201, 202, 204)").count() == 0


def test_lines(spark, docs):
    out = stage("line_dedup")(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    held = [r.doc_id for r in out.collect() if LINE in (r.text or "")]
    assert held == [59] and out.where("doc_id = 200 AND text IS NULL").count() == 1


def test_near_copies(spark, docs):
    lines = stage("line_dedup")(spark, docs, "")
    out = stage("near_dedup")(spark, lines, "")
    ids = Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns and set(range(60)) <= set(ids) and not set(range(100, 105)) & set(ids)
    assert ids[3] == 3 and ids[200] == ids[201] == 1  # rows that share a doc_id are one document


def test_mixing(spark, docs):
    """Every source comes near its target: whole documents, repeated up to twice."""
    from tessera.llm import mixing

    out = stage("mixing")(spark, docs, "")
    assert out.columns == docs.columns
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
    assert set(size(out)) <= set(size(docs))
    taken = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 1 for r in taken)
    assert max(Counter(r.doc_id for r in out.where("doc_id <> 3").collect()).values()) <= 2


def test_packing(spark, docs):
    from tessera.llm import packing

    out = stage("packing")(spark, docs, "").collect()
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.CAPACITY and len({r.doc_id for r in out}) == 70
    whole = Counter()
    for r in out:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] % r.doc_tokens == 0 for r in out)


def test_whole(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids and not ids & {100, 101, 102, 103, 104, 200, 201, 202, 204}


def test_empty(spark, docs):
    none = docs.where("false")
    for name, f in pipeline.STAGES:
        assert f(spark, none, "").count() == 0, name


@pytest.mark.parametrize("column", ["text", "lang", "source", "n_chars", "doc_id"])
def test_nulls_in_any_column(spark, docs, column):
    some = docs.where("doc_id < 40 OR doc_id >= 200").selectExpr(*[f"CASE WHEN doc_id % 2 = 0 THEN {c} END AS {c}" if c == column else c for c in docs.columns])
    for _, f in pipeline.STAGES:
        some = f(spark, some, "")
    assert some.count() >= 0
