"""A corpus pipeline: language ID, line dedup, near-dedup, mixing and packing, each an operator of ``tessera.llm``.

All stages but the last return the columns of ``documents`` as they came, whatever further ones there are. Each takes nulls
in any column, empty and very long texts, ties, repeated rows and an empty table; what comes of them is said below and in
the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import lang_id, line_dedup, minhash, mixing, packing


#: Rows of documents that Python workers get at once: bounds what they, and Spark's buffers beside them, hold of long texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For this session, also where a stage's result is written after its function has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: without text or letters, or mostly in letters that no learned language has.

    Where no language could be learned, those without letters go. Repeated rows stay or go together.
    """
    small_batches(spark)
    return lang_id.keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that at least 5 documents hold stay in the largest of these only.

    Every document stays, if without text; null text stays null. Rows that share a doc_id count as one document.
    """
    small_batches(spark)
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id: shingles of five words, similarity of 0.8 or more.

    Documents without text are copies of nothing and stay, as do rows without a doc_id.
    """
    small_batches(spark)
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, 0 to 2 times; one in which a budget ends counts as whole.

    Documents without words are never taken; a null source is one of its own. Ties of keys go by doc_id, so reruns agree.
    """
    small_batches(spark)
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens; null text is one closing token, repeated rows are packed each."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Language ID has a trained model and packing needs token ids: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
