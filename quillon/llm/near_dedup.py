"""Near-duplicate documents by circulant MinHash, exact Jaccard verification and distributed components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near import PACKED, pack, shared_buckets, similar_components, slots_of, travelled
from .scratch import drop, release, table, unused
from .shingles import CirculantMinHash, WordHashes, bands, digest, word_shingles

#: Two texts at the threshold of 0.75 miss all of 48 bands of 5 with a chance of 2e-6.
COORDINATES, ROWS = 240, 5
#: Coordinates of the longer signature of candidates. At the threshold its share of agreements has a deviation of 0.0135;
#: the second round verifies pairs from six deviations below on.
SHARP, SLACK = 1024, 0.08
#: Texts whose shingles are signed together.
TOGETHER = 128
SALTS = 64


ROWS_OF = "doc_id long, n_shingles long, id long, key binary, mark long"


def packed_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """The buckets of the sets of all rows (doc_id, text, mark), as ``near`` packs them, and ROWS_OF of every row along
    with them: a digest of its set, and the first 64 bits of that; null where the set is empty. Equal sets have one id."""
    slots = slots_of(docs)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
        words, minhash, seen = WordHashes(), CirculantMinHash(COORDINATES), set()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part, fresh, sizes, keys = batch.slice(at, TOGETHER), {}, [], []
                for text, known in zip(part.column(1), part.column(0).is_valid().to_pylist(), strict=True):
                    own = word_shingles(text.as_py(), words, k)
                    key = digest(own) if len(own) else None
                    sizes.append(len(own))
                    keys.append(key)
                    if known and key and key[:8] not in seen:
                        seen.add(key[:8])
                        fresh[key[:8]] = own
                ids = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in keys]
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), part.column(2)], ["doc_id", "n_shingles", "id", "key", "mark"])
                yield np.frombuffer(b"".join(fresh), np.int64), bands(minhash.signatures(list(fresh.values())), ROWS), rows
            if len(seen) > 300_000:
                seen.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(signed(batches), slots, TaskContext.get().partitionId())

    return docs.select("doc_id", "text", "mark").mapInArrow(run, PACKED)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """id, sig, content: the sets (their 64-bit elements, in order) of the documents (doc_id, id, key) that are wanted,
    once for each row of the document's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, minhash = WordHashes(), CirculantMinHash(SHARP, seed=23)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sets = [word_shingles(t, words, k) for t in part.column(0).to_pylist()]
                # A repeated document id may stand for another text, which is not the one that is asked for.
                right = [digest(s) == key for s, key in zip(sets, part.column(2).to_pylist(), strict=True)]
                sets, own = [s for s, ok in zip(sets, right, strict=True) if ok], part.column(1).filter(pa.array(right))
                sig = minhash.signatures(sets).astype(np.uint8)
                cols = [own, pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "sig", "content"])

    return docs.join(wanted.hint("merge"), "doc_id").select("text", "id", "key").mapInArrow(run, "id long, sig binary, content array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (id, content) have 100 * intersection >= percent * union."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("content").alias("eb")).hint("merge"), "b").join(sets.select(F.col("id").alias("a"), F.col("content").alias("ea")).hint("merge"), "a")
    both = joined.select("a", "b", F.size(F.array_intersect("ea", "eb")).alias("n"), (F.size("ea") + F.size("eb")).alias("total"))
    return both.where(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("a", "b")


def _elements(contents: list) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.asarray(c, np.int64).view(np.uint64) for c in contents]
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", k: int = 5, slack: float = SLACK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their sets of k-word shingles; component_id is
    the smallest doc_id that links reach. Texts of any length are read whole; texts without words (null, empty, white
    space) have an empty set and stay alone, and so do rows with a null id, whose component_id is null and which are
    kept. Repeated rows are all returned; all copies of the kept one have kept = true. Of rows with one id and
    different texts each has the component of its own text. Other columns are ignored, whatever their names; an empty
    table gives an empty result. With ``slack`` 1 the second round verifies all that share a bucket, whatever their
    signatures say.
    """
    return _rows(docs, percent, id_col, text_col, k, slack).select("doc_id", "n_shingles", "component_id", "kept")


def _mark(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col(text_col))


def _rows(docs: DataFrame, percent: int, id_col: str, text_col: str, k: int, slack: float = SLACK) -> DataFrame:
    """What ``near_duplicates`` gives, and mark and family (one number for each component; null without words or id)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _mark(text_col).alias("mark"))
    shared = table(shared_buckets(packed_sets(source, k)), "shared")
    rows = table(travelled(shared, ROWS_OF), "shingled")
    there = rows.where("key is not null and doc_id is not null")
    classes = table(there.groupBy("id", "key").agg(F.min("doc_id").alias("doc_id")), "classes")
    release(spark)
    candidates: list[DataFrame] = []

    def contents_of(ids: DataFrame) -> DataFrame:
        # Of different sets with one id, about as likely as a wrong bit on disk, one takes part in links.
        at = classes.join(ids.hint("merge"), "id").groupBy("id").agg(F.min(F.struct("key", "doc_id")).alias("x")).select("id", "x.key", "x.doc_id")
        candidates.append(table(at, "candidates"))
        return sets_of(source.where("doc_id is not null"), candidates[0], k)

    found = similar_components(shared, contents_of, lambda pairs, sets: verified(pairs, sets, percent), _elements, percent, slack)
    linked = found.join(candidates[0].select("id", "key"), "id")
    nodes = table(classes.join(linked.hint("merge"), ["id", "key"], "left").select("key", "doc_id", "label", "id"), "nodes")
    drop(candidates[0], classes, shared)
    least = table(nodes.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    labelled = nodes.join(least, "label").select("key", "component_id", F.col("label").alias("family")).union(nodes.where("label is null").select("key", F.col("doc_id").alias("component_id"), "id"))
    labelled = table(labelled, "labelled")
    drop(nodes, least)
    # Of joins with written tables adaptive execution splits hot keys; a class of equal sets has SALTS heads at most.
    salted = there.select("doc_id", "n_shingles", "key", "mark", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    heads = salted.select("key", "salt").distinct().join(labelled, "key")
    full = salted.join(heads.hint("merge"), ["key", "salt"]).select("doc_id", "n_shingles", "component_id", "mark", "family")
    alone = rows.where("key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "mark", F.lit(None).cast("long").alias("family"))
    return full.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` less its near-duplicates: of each component the document with the smallest id stays, once.

    What goes is decided for rows, not ids: of rows with one id and different texts each stays that is the first of its
    own component, and of several rows of that id in one component one. Rows without words stay, repeated ones once;
    rows with a null id stay. All columns stay, whatever their names; an empty table gives an empty result.
    """
    mark = unused(docs.columns, "mark")
    rows = table(_rows(docs, percent, "doc_id", "text", 5).where("doc_id is not null").select("doc_id", "mark", "family", "kept"), "decided")
    first = rows.where("kept and family is not null").groupBy("doc_id", "family").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least < most")
    later = rows.where("kept").join(first, ["doc_id", "family"]).where("mark > least").select("doc_id", "mark")
    gone = rows.where("not kept").select("doc_id", "mark").union(later).distinct().withColumnRenamed("mark", mark)
    kept = docs.where("doc_id is not null").withColumn(mark, _mark("text")).join(gone, ["doc_id", mark], "left_anti").dropDuplicates(["doc_id", mark]).drop(mark)
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


ORACLE = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) c ON c.node = d.doc_id
"""
