"""Ranked lexical search with block-max pruning.

The terms of the queries number what is indexed: a task reads whole texts and writes blocks of consecutive documents, a
forward index of the numbered terms of each and how often each occurs. Statistics (documents, terms, documents of each
term) are sums over the blocks. A searching task then holds some hundred blocks at a time: for each it has the greatest
share that any document of the block gives to each term, so that a query's bound is a weighted sum over its terms. Of a
query the blocks are taken by falling bound, and all documents of a block scored, until the bound falls below the
query's threshold: the k-th best score so far. What falls away cannot be among the best k. Only the best k of each task
are shuffled. Queries of more terms than ``TERMS`` are searched in turns, so that what a task holds is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table
from .terms import terms

#: Documents of a block, and entries of its forward index; a longer document is a block of its own.
DOCUMENTS, ENTRIES = 64, 16_384
#: Blocks that a searching task bounds together.
TOGETHER = 256
#: Distinct terms, occurrences of terms, and queries of one turn: what travels to every task.
TERMS, OCCURRENCES, QUERIES = 200_000, 1_000_000, 20_000
#: The parts of a document's measure that are fixed, and that grow with its length, in hundredths.
FIXED, BY_LENGTH = 25, 75

INDEX = "doc_ids array<long>, lengths array<long>, sizes binary, terms binary, times binary, df_terms array<int>, df array<long>, n long, total long"


class Queries:
    """Queries of one turn: places of their terms in the vocabulary, with repeats."""

    def __init__(self, rows: list[tuple[int, list[bytes]]]) -> None:
        self.items = [i for i, _ in rows]
        vocabulary = sorted({t for _, own in rows for t in own})
        self.number = {t: k for k, t in enumerate(vocabulary)}
        found = [np.unique([self.number[t] for t in own], return_counts=True) for _, own in rows]
        self.terms = [t for t, _ in found]
        self.times = [n.astype(np.int64) for _, n in found]


def turns_of(rows: list[tuple[int, list[bytes]]]) -> list[list[tuple[int, list[bytes]]]]:
    """The queries cut into turns within TERMS, OCCURRENCES and QUERIES; a query beyond them is a turn of its own."""
    turns, seen, many = [], set(), 0
    for row in rows:
        own = seen | set(row[1])
        if turns and len(turns[-1]) < QUERIES and len(own) <= TERMS and many + len(row[1]) <= OCCURRENCES:
            turns[-1].append(row)
            seen, many = own, many + len(row[1])
        else:
            turns.append([row])
            seen, many = set(row[1]), len(row[1])
    return turns


def forward_index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """INDEX: blocks of the rows (doc_id, text) with the numbered terms of each document. Documents without any term and
    without an id are only counted."""

    def block(ids: list[int], lengths: list[int], found: list[tuple[np.ndarray, np.ndarray]], n: int, total: int, df: dict[int, int]) -> pa.RecordBatch:
        joined = lambda k, kind: np.concatenate([x[k] for x in found] or [np.zeros(0)]).astype(kind).tobytes()
        known = sorted(df)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        cols = {"doc_ids": one(ids, pa.int64()), "lengths": one(lengths, pa.int64()), "sizes": pa.array([np.array([len(x[0]) for x in found], np.int32).tobytes()], pa.binary()),
                "terms": pa.array([joined(0, np.int32)], pa.binary()), "times": pa.array([joined(1, np.int32)], pa.binary()),
                "df_terms": one(known, pa.int32()), "df": one([df[t] for t in known], pa.int64()), "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, found, entries, n, total, df = [], [], [], 0, 0, 0, {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = terms(text.as_py())
                if not own:
                    continue
                n, total = n + 1, total + len(own)
                at = np.array([t for t in map(number.get, own) if t is not None], np.int32)
                if not len(at):
                    continue
                known, times = np.unique(at, return_counts=True)
                for t in known.tolist():
                    df[t] = df.get(t, 0) + 1
                if doc is None:
                    continue
                if ids and (len(ids) >= DOCUMENTS or entries + len(known) > ENTRIES):
                    yield block(ids, lengths, found, n, total, df)
                    ids, lengths, found, entries, n, total, df = [], [], [], 0, 0, 0, {}
                ids.append(doc)
                lengths.append(len(own))
                found.append((known, times))
                entries += len(known)
        if n:
            yield block(ids, lengths, found, n, total, df)

    return docs.mapInArrow(run, INDEX)


class Block:
    """A block ready to be searched: shares of all entries, and of each of its terms the greatest."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, found: np.ndarray, times: np.ndarray, n: int, total: int) -> None:
        self.ids = ids
        measure = FIXED + BY_LENGTH * lengths * n // total
        self.row = np.repeat(np.arange(len(ids)), sizes)
        times = times.astype(np.int64)
        share = 1_000_000_000 * times // (1000 * times + 8 * measure[self.row])
        self.terms, self.of = np.unique(found, return_inverse=True)
        self.most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(self.most, self.of, share)
        self.share = share

    def bounds(self, terms: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of queries; ``terms`` and ``weights`` of all queries, each from its ``first`` on."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = np.where(self.terms[at] == terms, self.most[at], 0) * weights
        return np.add.reduceat(held, first)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of all documents of the block."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        weight = np.zeros(len(self.terms), np.int64)
        weight[at[there]] = weights[there]
        own = weight[self.of]
        some = np.flatnonzero(own)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.row[some], own[some] * self.share[some])
        return out


class Best:
    """The best k documents of a query; of equal scores the smallest ids."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        """What a document needs at least; at the threshold itself its id decides."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= self.threshold
        if some.any():
            ids, scores = np.concatenate([self.ids, ids[some]]), np.concatenate([self.scores, scores[some]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[order], scores[order]


def search_blocks(blocks: list[Block], best: list[Best], terms: list[np.ndarray], weights: list[np.ndarray]) -> int:
    """Search blocks for all queries; how many pairs of query and block were scored."""
    first = np.cumsum([0, *(len(t) for t in terms[:-1])])
    all_terms, all_weights = np.concatenate(terms), np.concatenate(weights)
    bounds = np.stack([b.bounds(all_terms, all_weights, first) for b in blocks])
    scored = 0
    for q, own in enumerate(best):
        for k in np.argsort(-bounds[:, q], kind="stable").tolist():
            if bounds[k, q] < own.threshold:
                break
            own.take(blocks[k].ids, blocks[k].scores(terms[q], weights[q]))
            scored += 1
    return scored


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


FOUND = "query int, doc_id long, score long"


def _turn(docs: DataFrame, rows: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """FOUND: the best k of each task for each query (its place among ``rows``)."""
    queries = Queries(rows)
    number = queries.number
    index = table(forward_index(docs, number), "forward-index")
    n, total = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    # A row for each term of the turn, at most TERMS.
    df = {r.term: r.df for r in index.select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy(F.col("x.df_terms").alias("term")).agg(F.sum("x.df").alias("df")).collect()}
    weights = [np.array([weight(n, df.get(t, 0)) for t in own.tolist()], np.int64) * times for own, times in zip(queries.terms, queries.times, strict=True)]
    own_terms = queries.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = [Best(k) for _ in own_terms], []
        for batch in batches:
            for at in range(batch.num_rows):
                ids, lengths = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in (0, 1))
                sizes, found, times = (np.frombuffer(batch.column(c)[at].as_py(), np.int32) for c in (2, 3, 4))
                if len(ids):
                    held.append(Block(ids, lengths, sizes, found, times, n, total))
                if len(held) >= TOGETHER:
                    search_blocks(held, best, own_terms, weights)
                    held = []
        if held:
            search_blocks(held, best, own_terms, weights)
        some = [q for q, b in enumerate(best) if len(b.ids)]
        cols = [np.repeat(np.array(some, np.int32), [len(best[q].ids) for q in some]), *(np.concatenate([getattr(best[q], c) for q in some] or [np.zeros(0, np.int64)]) for c in ("ids", "scores"))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["query", "doc_id", "score"])

    return index.select("doc_ids", "lengths", "sizes", "terms", "times").mapInArrow(run, FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (item_id, text) with a score above 0: item_id, rank, doc_id,
    score; of equal scores the smaller doc_id comes first.

    Terms are those of ``terms``. With N documents that have a term, L terms in all, n terms in a document and df
    documents that hold a term, its weight is floor(1000 * ln((2N + 2) / (2df + 1))); the document's measure is
    25 + (75 * n * N) div L, and a score adds, over an item's terms with repeats, weight * (10**9 * tf div (1000 * tf +
    8 * measure)). Null, empty and termless texts have no terms: such documents count in nothing, such items find
    nothing. Repeated rows of documents count and are returned each; a row without an id counts but is never returned.
    Repeated rows of an item are searched once; different texts of one item_id are searched apart, with ranks of their
    own. Texts of any length are read whole; other columns are ignored; empty tables give an empty result.

    The items are read by the driver in turns of bounded size; documents and their index never are.
    """
    spark = docs.sparkSession
    source = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    asked = items.selectExpr("cast(item_id as long) as item_id", "text").where("text is not null").distinct().orderBy("item_id", "text")
    out = None

    def turns() -> Iterator[list[tuple[int, list[bytes]]]]:
        held: list[tuple[int, list[bytes]]] = []
        for row in asked.toLocalIterator():
            own = terms(row.text)
            if own:
                held.append((row.item_id, own))
            if len(held) > QUERIES:
                *full, held = turns_of(held)
                yield from full
        yield from turns_of(held) if held else []

    for rows in turns():
        found = _turn(source, rows, k)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id"))
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(rows)], "query int, item_id long")  # QUERIES rows at most
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY 1),
p AS (SELECT f.doc_id, f.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))) AS x FROM f JOIN w ON w.term = f.term JOIN d ON d.doc_id = f.doc_id, s),
r AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
