"""From raw documents to packed training windows: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import line_dedup, near_dedup, packing, pii, quality
from quillon.llm.queries import read, tokenizer
from quillon.llm.scratch import table


def _like(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with the columns and types of ``docs``, the number of characters being that of the text."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return new.select([F.col(c).cast(t).alias(c) for c, t in docs.dtypes])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the documents that came in. Null and empty
    texts are scored as empty ones; repeated rows go or stay together; rows with a null id are scored like others."""
    return quality.good_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines one occurrence stays. No row goes; null texts and rows with a null id stay."""
    return _like(docs, line_dedup.dedup_lines(docs, counts=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Rows without words or with a null id stay."""
    return _like(docs, near_dedup.one_of_each(docs))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format. No row goes; null texts stay null."""
    return _like(docs, pii.pseudonymise(docs, pii.session_key(spark), counts=False))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids, of every row; null and empty texts are the end id alone."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), size=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", fuzzy_lines),
    ("MinHash near-dedup", near_duplicates),
    ("PII", pseudonyms),
    ("packing", packed),
]

#: Training, signatures and tokenizing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Of an empty table: no rows. Every column of documents goes through all stages but the last."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
