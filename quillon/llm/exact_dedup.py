"""Exact duplicates by content sort, with DataFrame functions only.

Rows are range-partitioned on the normalised bytes by Spark's sampled splitters (on a prefix of them, then a hash that
only spreads texts with one prefix), sorted externally, and each row is compared with its neighbour by full content: a
run of equal texts is what Spark's window finds between two neighbours that differ. The digest is an output only.

A text that makes up more of the table than a task should read is known beforehand by counts. It has a salt as the last
part of the range key, so splitters fall inside it; the heads of its parts, a bounded number, are merged by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

#: Leading characters of the normalised text in the range key. Splitters hold this much of a text at most.
KEY_CHARS = 48
#: Parts that one group of equal texts can be split into, and rows that make a text frequent enough for that.
SALTS, FREQUENT = 256, 1000
#: Frequent texts for each shuffle partition: any other text has less than a quarter of a partition's share of rows.
HOT = 4


def normalised(text: Column) -> Column:
    """Each run of ASCII white space is one space; null is empty. Single spaces, which stay, are not matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: Callable[[Column], Column] = F.xxhash64, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other; texts of any length are read whole. A repeated row (same id and text)
    counts in group_size each time; all its copies have kept = (doc_id = keep_id). A null id is never kept unless its
    group has no other id. Columns of ``docs`` other than the two are ignored, whatever their names. An empty table gives
    an empty result. ``spread`` orders texts with one prefix; results don't depend on it.
    """
    spark = docs.sparkSession
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = norm.select("doc_id", "norm", spread(F.col("norm")).cast("long").alias("spread"))
    most = HOT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = keyed.groupBy("spread").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= frequent).orderBy(F.col("n").desc()).limit(most)
    # ``most`` numbers at most.
    held = keyed.join(F.broadcast(hot.select("spread", F.lit(True).alias("hot"))), "spread", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    held = held.select(F.substring("norm", 1, KEY_CHARS).alias("head"), "spread", salt.alias("salt"), F.coalesce("hot", F.lit(False)).alias("hot"), "doc_id", "norm")
    # The window's keys include those of the range, so Spark adds no exchange; its sort is the external content sort.
    ranged = held.repartitionByRange("head", "spread", "salt")
    run = Window.partitionBy("head", "spread", "salt", "norm")
    first = F.row_number().over(run.orderBy(F.col("doc_id").asc_nulls_last()))
    placed = ranged.withColumn("nth", first).withColumn("low", F.min("doc_id").over(run)).withColumn("n", F.count(F.lit(1)).over(run))
    head_of_part = F.when(F.col("hot") & (F.col("nth") == 1), F.col("norm"))
    placed = table(placed.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "hot", "salt", "low", "n", head_of_part.alias("content")), "content-sort")
    settled = placed.where("not hot").select("doc_id", F.col("low").alias("keep_id"), F.col("n").alias("group_size"), "text_sha256")
    # Parts of frequent texts: SALTS heads at most for each, equal if their whole contents are. A part's rows carry its
    # name (digest, salt, least id), and there are as many parts as salts, so the join is even.
    heads = placed.where("content is not null").select("content", "text_sha256", "salt", "low", "n")
    total = heads.groupBy("content").agg(F.min("low").alias("keep_id"), F.sum("n").cast("long").alias("group_size"))
    found = heads.join(total, "content").select("text_sha256", "salt", F.coalesce("low", F.lit(0)).alias("at"), F.col("low").isNull().alias("none"), "keep_id", "group_size")
    parts = placed.where("hot").select("doc_id", "text_sha256", "salt", F.coalesce("low", F.lit(0)).alias("at"), F.col("low").isNull().alias("none"))
    merged = parts.join(found, ["text_sha256", "salt", "at", "none"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    out = settled.unionByName(merged)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
