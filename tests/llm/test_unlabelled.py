"""The pipeline's language stage where no language can be learned."""

from tessera.llm import lang_id


def test_keeps_letters_without_labels(spark):
    rows = [(0, "plain words", None), (1, "слова", None), (2, "漢字", None), (3, "12 %", None), (4, "", None), (5, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = lang_id.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
