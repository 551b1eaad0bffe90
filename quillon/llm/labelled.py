"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and one 0/1 label for each id: null ids and labels go, of repeated rows the larger label stays."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def ids_sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` of the rows, those whose hashed id is smallest; the same ones at each run."""
    return rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, label, text of the sampled ids. The broadcast side has at most as many rows as its sample's bound."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(ids), "doc_id")
