"""Language ID: held-out accuracy, ties, odd rows, and what the pipeline's stage keeps."""

import numpy as np
import pytest

from tessera.llm import lang_id


def words(seed, letters, n):
    """Texts of an invented language: syllables of its own."""
    rng = np.random.default_rng(seed)
    syllables = ["".join(rng.choice(list(letters), 2)) for _ in range(60)]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary, rng.integers(8, 60))) for _ in range(n)]


def test_held_out_accuracy(spark):
    """Three languages of one alphabet, told apart by their words: the quarter that is held out is never learned from."""
    rows = [(100 * k + i, t, f"l{k}") for k in range(3) for i, t in enumerate(words(k, "abcdefgh", 100))]
    out = lang_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in out if r.held_out]
    assert len(out) == 300 and 40 < len(held) < 110 and all(0 < r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98


def test_ties_and_odd_rows(spark):
    model = lang_id.Model({"b": "same text", "a": "same text"})
    assert [lang for lang, *_ in model.predict(["same", None, "", "12 %", "\u6f22", "same " * 50_000])] == ["a", "und", "und", "und", "a", "a"]
    rows = [(1, "some words", "x", "y"), (1, "some words", "x", "y"), (2, None, "x", "y"), (None, "some words", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    out = lang_id.digest(df).collect()
    assert len(out) == 4 and len({tuple(r) for r in out if r.doc_id == 1}) == 1
    assert lang_id.keep_known(df).columns == df.columns and lang_id.digest(df.where("false")).count() == 0


@pytest.mark.parametrize(("text", "kept"), [("den hund og", True), ("\u6f22\u5b57\u6f22\u5b57", False), ("hund \u6f22", True), ("123", False), (None, False)])
def test_the_stage_drops_other_scripts(spark, text, kept):
    rows = [(i, "der er en hund og den spiser", "da") for i in range(8)] + [(99, text, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert lang_id.keep_known(df).where("doc_id = 99").count() == int(kept)
