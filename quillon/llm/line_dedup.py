"""Fuzzy duplicates of lines across all documents; of each component of similar lines one occurrence stays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import PACKED, pack, shared_buckets, similar_components, slots_of, travelled
from .scratch import drop, release, table, unused
from .shingles import MinHash, bands, char_shingles

#: Characters of a shingle; two lines at the threshold of 0.8 miss all of 20 bands of 7 with a chance of 9e-3, at 0.85 5e-4.
#: Shorter bands bring together many more lines that have nothing in common, the more the larger the corpus is.
SHINGLE, COORDINATES, ROWS = 5, 140, 7
#: Lines are not verified in the second round if their signatures agree in less than 0.64, 4.7 deviations below 0.8.
SLACK = 0.16
#: Characters of lines that are signed together.
TOGETHER = 1 << 16
WHITE = re.compile(r"[\x20\x09\x0B-\x0D]+")


def normalised(line: str) -> str:
    if "  " in line or "\t" in line or "\r" in line or "\x0b" in line or "\x0c" in line:
        line = WHITE.sub(" ", line)
    return line.strip(" ")


def lines_of(text: str | None, least: int) -> list[tuple[int, str]]:
    """Numbers and normalised texts of the lines of ``least`` characters or more."""
    lines = (text or "").split("\n")
    if text and ("  " in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text):
        lines = map(normalised, lines)
    else:
        lines = [x.strip(" ") for x in lines]
    return [(i, x) for i, x in enumerate(lines) if len(x) >= least]


def digests(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lines are equal if these 96 bits are: id, by which candidates are found, and chk."""
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode()) for x in lines]), np.dtype([("id", "<i8"), ("chk", "<u4"), ("rest", "<u4")]))
    return raw["id"].astype(np.int64), raw["chk"].astype(np.int64)


def packed_lines(docs: DataFrame, least: int) -> DataFrame:
    """The buckets of all lines, as ``near`` packs them, and the places of all lines of ``least`` characters or more
    along with them, so that texts are read once for both."""
    slots = slots_of(docs)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
        minhash, seen = MinHash(COORDINATES), set()
        lines, counts, numbers, size, ids = [], [], [], 0, []

        def rows() -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
            own, chk = digests(lines)
            fresh = []
            for k, i in enumerate(own.tolist()):  # equal lines are signed once in a task, most of the time
                if i not in seen:
                    seen.add(i)
                    fresh.append(k)
            new = [lines[k] for k in fresh]
            places = [np.repeat(np.array(ids, np.int64), counts), np.array(numbers, np.int32), own, chk]
            return own[fresh], bands(minhash.of(*char_shingles(new, SHINGLE, short=True), len(new)), ROWS), pa.RecordBatch.from_arrays([pa.array(c) for c in places], ["doc_id", "line_no", "id", "chk"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = lines_of(text.as_py(), least)
                ids.append(i)
                counts.append(len(found))
                for n, line in found:
                    numbers.append(n)
                    lines.append(line)
                    size += len(line)
                if size > TOGETHER:
                    yield rows()
                    lines, counts, numbers, size, ids = [], [], [], 0, []
                    if len(seen) > 300_000:
                        seen.clear()
        if lines:
            yield rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(signed(batches), slots, TaskContext.get().partitionId())

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def texts_at(docs: DataFrame, at: DataFrame) -> DataFrame:
    """id, sig, content: the texts of lines (id, chk, doc_id, line_no), which are read again from their documents, once
    for each row of the document's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(COORDINATES)

        def rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
            lines = [x for _, _, x in found]
            ids, chk = digests(lines)
            # A repeated document id may stand for another text, which is not the one that is asked for.
            right = (ids == np.array([i for i, _, _ in found], np.int64)) & (chk == np.array([c for _, c, _ in found], np.int64))
            sig = minhash.of(*char_shingles(lines, SHINGLE, short=True), len(lines)).astype(np.uint8)
            cols = [pa.array(ids), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(lines, pa.string())]
            return pa.RecordBatch.from_arrays(cols, ["id", "sig", "content"]).filter(pa.array(right))

        for batch in batches:
            found, size = [], 0
            for text, own in zip(batch.column(0), batch.column(1), strict=True):
                lines = (text.as_py() or "").split("\n")
                for x in own.as_py():
                    if x["line_no"] < len(lines):
                        found.append((x["id"], x["chk"], normalised(lines[x["line_no"]])))
                        size += len(found[-1][2])
                if size > TOGETHER:
                    yield rows(found)
                    found, size = [], 0
            if found:
                yield rows(found)

    wanted = at.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id", "chk")).alias("own"))
    return docs.join(wanted.hint("merge"), "doc_id").select("text", "own").mapInArrow(run, "id long, sig binary, content string")


def verified_lines(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose lines (id, content) have 100 * intersection >= percent * union of their shingles."""
    joined = pairs.join(lines.selectExpr("id as b", "content as lb").hint("merge"), "b").join(lines.selectExpr("id as a", "content as la").hint("merge"), "a").select("a", "b", "la", "lb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lines = [t for c in (2, 3) for t in part.column(c).to_pylist()]
                x, owner = char_shingles(lines, SHINGLE)
                n = part.num_rows
                # The pair, 55 bits of the stretch, and the side in one number: sorted, what both sides have are neighbours.
                side = (owner >= n).astype(np.uint64)
                mark = np.where(owner < n, owner, owner - n).astype(np.uint64) << np.uint64(56) | x >> np.uint64(9) << np.uint64(1) | side
                mark.sort()
                mark = mark[np.r_[True, mark[1:] != mark[:-1]]] if len(mark) else mark
                whole = mark >> np.uint64(1)
                common = np.bincount((mark[1:][whole[1:] == whole[:-1]] >> np.uint64(56)).astype(np.int64), minlength=n)
                total = np.bincount((mark >> np.uint64(56)).astype(np.int64), minlength=n)
                keep.append(100 * common >= percent * (total - common))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return joined.mapInArrow(run, "a long, b long")


def dropped_lines(docs: DataFrame, percent: int = 80, least: int = 1, slack: float = SLACK) -> DataFrame:
    """doc_id, drops: the numbers of the lines (from 0) that go, for the documents that lose some.

    Lines are linked where 100 * intersection >= percent * union of their 5-character shingles, white space normalised.
    Of a component the occurrence with the smallest (doc_id, line number) stays; of two rows with that id and different
    texts, the line of that number stays in both. Rows with a null id do not count. An empty table gives an empty result.
    With ``slack`` 1 the second round verifies all that share a bucket, whatever their signatures say.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text").where("doc_id is not null")
    shared = table(shared_buckets(packed_lines(docs, least)), "shared")
    places = table(travelled(shared, "doc_id long, line_no int, id long, chk long"), "places")
    classes = table(places.groupBy("id", "chk").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    release(spark)
    candidates: list[DataFrame] = []

    def contents_of(ids: DataFrame) -> DataFrame:
        # Of different lines with one id, about as likely as a wrong bit on disk, one takes part in links.
        at = classes.join(ids.hint("merge"), "id").groupBy("id").agg(F.min(F.struct("chk", "first")).alias("x")).select("id", "x.chk", "x.first.doc_id", "x.first.line_no")
        candidates.append(table(at, "candidates"))
        return texts_at(docs, candidates[0])

    similar = similar_components(shared, contents_of, lambda pairs, lines: verified_lines(pairs, lines, percent), lambda lines: char_shingles(lines, SHINGLE), percent, slack)
    release(spark)
    linked = similar.join(candidates[0].select("id", "chk"), "id")
    repeated = classes.join(linked.hint("merge"), ["id", "chk"], "left").where("n > 1 or label is not null")
    repeated = table(repeated.select("id", "chk", "first", F.coalesce("label", "id").alias("group"), F.when(F.col("label").isNull(), F.col("chk")).otherwise(-1).alias("kind")), "repeated")
    drop(classes, candidates[0], shared)
    # Minima are combined before they are shuffled; of the joins with written tables adaptive execution splits hot keys.
    stays = table(repeated.groupBy("group", "kind").agg(F.min("first").alias("stays")), "stays")
    found = table(repeated.join(stays, ["group", "kind"]).select("id", "chk", "stays"), "found")
    gone = places.join(found.hint("merge"), ["id", "chk"]).where(~((F.col("doc_id") == F.col("stays.doc_id")) & (F.col("line_no") == F.col("stays.line_no"))))
    drops = table(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("drops")), "drops")
    drop(places, repeated, stays, found)
    release(spark)
    return drops


def _without(texts: pd.Series, drops: pd.Series) -> pd.Series:
    def left(text: str | None, own: np.ndarray | None) -> str | None:
        if text is None or own is None:
            return None
        gone = set(own.tolist())
        return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone])

    return pd.Series([left(t, d) for t, d in zip(texts, drops, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, percent: int = 80, least: int = 1, counts: bool = True) -> DataFrame:
    """``docs`` with its text less the lines that go, and with ``counts`` n_lines, n_dropped.

    A document that loses no line keeps its text byte for byte. Lines shorter than ``least`` characters, by default the
    empty ones, always stay; a line of five characters or fewer is similar to equal ones only. Texts and lines of any
    length are read whole. Null texts stay null, with counts 0; texts that lose all lines become empty. Rows with a null
    id stay as they are and do not count; repeated rows (same id and text) are treated alike. Of equal lines the
    smallest (doc_id, line number) stays. Other columns stay, whatever their names, but n_lines and n_dropped are
    replaced where they are asked for. An empty table gives an empty result.
    """
    own, gone = unused(docs.columns, "own_id"), unused(docs.columns, "gone")
    drops = dropped_lines(docs, percent, least).withColumnsRenamed({"doc_id": own, "drops": gone})
    joined = docs.join(drops.hint("merge"), docs["doc_id"].cast("long") == drops[own], "left")
    out = joined
    if counts:
        out = out.withColumn("n_lines", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"))
        out = out.withColumn("n_dropped", F.when(F.col("text").isNull() | F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    # Texts that lose nothing don't leave the JVM.
    left = F.pandas_udf(_without, "string")(F.when(F.col(gone).isNotNull(), F.col("text")), F.col(gone))
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).drop(own, gone)
