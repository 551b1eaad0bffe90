"""Operators on tables of vectors (array<float>)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import dot, norm
from quillon.storage import written


def centroids(df: DataFrame, keys: list[str], vector: str, unit: bool = True) -> DataFrame:
    """Mean vector by key; with ``unit`` scaled to length one, and left out if its length is zero."""
    parts = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    if not unit:
        return listed
    size = norm(F.col("centroid"))
    return listed.withColumn("__n", size).where("__n > 0").withColumn("centroid", F.transform("centroid", lambda x: x / F.col("__n"))).drop("__n")


def divergences(df: DataFrame, event: str, block: str, vector: str) -> DataFrame:
    """1 - cosine of the centroids of each pair of blocks a < b of an event, within 0 and 1."""
    c = centroids(df, [event, block], vector)
    a = c.select(event, F.col(block).alias("block_a"), F.col("centroid").alias("ca"))
    b = c.select(event, F.col(block).alias("block_b"), F.col("centroid").alias("cb"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot(F.col("ca"), F.col("cb"))))
    return a.join(b, event).where("block_a < block_b").select(event, "block_a", "block_b", score.alias("score"))


def coherence(df: DataFrame, group: str, vector: str) -> DataFrame:
    """1 - d**2 / 2, d being the mean distance of a group's vectors to its centroid."""
    c = centroids(df, [group], vector, unit=False)
    d = F.sqrt(F.aggregate(F.zip_with(vector, "centroid", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return df.join(c, group).groupBy(group).agg(F.avg(d).alias("mean_distance"), F.count(F.lit(1)).alias("n")).withColumn("coherence", 1 - F.col("mean_distance") * F.col("mean_distance") / 2)


#: Vectors that are compared with one product of matrices; in a large table, at most so many.
BLOCK, LARGEST_BLOCK = 4096, 16384


def _block_rows(n: int) -> int:
    """Rows of a block of a table for comparing all with all. Each vector goes to as many tasks as there are blocks, so they
    grow with the table once it has 16, as far as a task can hold."""
    return max(BLOCK, min(LARGEST_BLOCK, -(-n // 16)))


def _n_blocks(n: int) -> int:
    return max(1, -(-n // _block_rows(n)))


def _blocks(df: DataFrame, id_col: str, vector: str, n: int) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int").alias("block"))


FOUND = "id long, neighbour long, distance double"


def _best(k: int, include_self: bool, most_distance: float | None = None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The best k rows of each query of a cell (id, v, query: which of both it is), of those within a distance, and within
    the query's own one where there is a column ``tau``."""

    def best(cell: pd.DataFrame) -> pd.DataFrame:
        q, r = cell[cell["query"]].sort_values("id"), cell[~cell["query"]].sort_values("id")
        if not len(q) or not len(r):
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []}).astype({"id": "int64", "neighbour": "int64", "distance": "float64"})
        a, b = np.stack(q["v"].to_numpy()).astype(np.float64), np.stack(r["v"].to_numpy()).astype(np.float64)
        qi, ri = q["id"].to_numpy(), r["id"].to_numpy()
        tau = q["tau"].to_numpy() * (1 + 1e-9) if "tau" in q else None
        sizes = (b * b).sum(1)
        longest, slack = sizes[np.isfinite(sizes)].max(initial=0.0), 8 * (b.shape[1] + 2) * np.finfo(np.float64).eps
        out, step = [], max(1, min(256, (256 * 4096) // len(b)))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            d = (part * part).sum(1)[:, None] + sizes - 2 * part @ b.T
            if not include_self:
                d[qi[at : at + step, None] == ri] = np.inf
            # All rows within the k-th smallest distance and what rounding may add: ties are settled on exact distances.
            d[~np.isfinite(d)] = np.inf
            m = min(k, len(b))
            most = np.partition(d, m - 1, axis=1)[:, m - 1] + slack * ((part * part).sum(1) + longest)
            for i in range(len(part)):
                own = np.flatnonzero((d[i] <= most[i]) & (d[i] < np.inf))
                exact = np.sqrt(((b[own] - part[i]) ** 2).sum(1))
                order = np.lexsort((ri[own], exact))[:k]
                if most_distance is not None:
                    order = order[exact[order] <= most_distance]
                if tau is not None:
                    order = order[exact[order] <= tau[at + i]]
                out += [(qi[at + i], ri[own[o]], exact[o]) for o in order]
        return pd.DataFrame(out, columns=["id", "neighbour", "distance"])

    return best


def knn(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", most_distance: float | None = None, include_self: bool = False) -> DataFrame:
    """The k nearest rows of each query by L2 distance: id, neighbour, distance, rank; of equals the smaller id.

    Queries and rows are dealt into blocks (``_n_blocks``); each pair of blocks is one product of matrices in one task,
    which keeps the best k of each query, and a ranked merge keeps the best k of all. Nothing is broadcast and no pair
    outside the best k, or farther apart than ``most_distance``, leaves a task. The work is queries times rows, as for
    any exact search.
    """
    n_rows, n_queries = rows.count(), queries.count()
    nr, nq = _n_blocks(n_rows), _n_blocks(n_queries)
    left = _blocks(queries, id_col, vector, nq).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).select("id", "v", F.lit(True).alias("query"), (F.col("block") * nr + F.col("other")).alias("cell"))
    right = _blocks(rows, id_col, vector, nr).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select("id", "v", F.lit(False).alias("query"), (F.col("other") * nr + F.col("block")).alias("cell"))

    found = left.unionByName(right).groupBy("cell").applyInPandas(_best(k, include_self, most_distance), FOUND)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Rows that cells are fitted on, and cells, at most.
CELL_SAMPLE, MOST_CELLS = 20_000, 1024
#: Queries whose cells a task holds at once.
ASKED = 128


@dataclass
class CellIndex:
    """Rows (id, v, cell) by their nearest centre; of each cell its rows, and the least and greatest distance to its centre."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _to_centres(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (centres * centres).sum(1) - 2 * v @ centres.T, 0))


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.float64)


def cell_index(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, seed: int = 1) -> CellIndex:
    """An inverted file: all rows by cell. Centres are fitted on CELL_SAMPLE rows at most, those of the smallest hashes;
    they decide how much a search reads, never what it finds."""
    own = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    sample = own.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(CELL_SAMPLE).toPandas()
    if not len(sample):
        return CellIndex(written(own.withColumn("cell", F.lit(0)), "cells"), np.zeros((1, 1)), *(np.zeros(1) for _ in range(3)))
    v = _vectors(sample)
    n = min(cells or max(1, int(len(v) ** 0.5)), MOST_CELLS, len(v))
    centres = v[np.random.default_rng(seed).choice(len(v), n, replace=False)]
    for _ in range(10):
        near = _to_centres(v, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, v)
        count = np.bincount(near, minlength=n)[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)

    def assigned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x = _vectors(pdf)
                cell = _to_centres(x, centres).argmin(1)
                yield pdf.assign(cell=cell, r=np.sqrt(((x - centres[cell]) ** 2).sum(1)))

    table = written(own.mapInPandas(assigned, f"id long, v {dict(own.dtypes)['v']}, cell int, r double"), "cells")
    of = {r.cell: r for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}  # a row a cell
    figures = np.array([(of[c].n, of[c].lo, of[c].hi) if c in of else (0, np.inf, -np.inf) for c in range(n)])
    return CellIndex(table.drop("r"), centres, *figures.T)


def _pieces(centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, parts: the rows of a cell lie in pieces first, first + 1, ... by parts. Cells near each other share a piece as
    far as a block's rows allow, a larger cell has several of its own."""
    most, chain, left = _block_rows(int(sizes.sum())), [0], np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        near = np.where(left, ((centres - centres[chain[-1]]) ** 2).sum(1), np.inf)
        chain.append(int(near.argmin()) if np.isfinite(near).any() else int(left.argmax()))
        left[chain[-1]] = False
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes.astype(np.int64) // most))
    piece, held = 0, 0
    for c in chain:
        if held and held + sizes[c] > most:
            piece, held = piece + 1, 0
        first[c], held = piece, held + sizes[c]
        if parts[c] > 1:
            piece, held = piece + parts[c], 0
    return first, parts


def knn_by_cells(queries: DataFrame, index: CellIndex, k: int, id_col: str = "vec_id", vector: str = "embedding", include_self: bool = False) -> tuple[DataFrame, float]:
    """What ``knn`` gives, and the share of all pairs of query and row that were compared.

    A query is first compared with the nearest cells that hold k rows, which bounds its k-th distance. By the triangle
    inequality a row of a cell is no nearer than the distance to the centre less the cell's greatest radius, or its least
    radius less that distance: only cells that can reach below the bound are compared too. The result is exact.

    Cells are held in pieces of a block's rows, and a query goes once to each piece of which it asks a cell. So however many
    cells it asks, no more is shuffled than by ``knn``, and beyond the bound nothing leaves a task.
    """
    centres, sizes, least, most = index.centres, index.sizes, index.least, index.most
    own = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    kind = dict(own.dtypes)["v"]
    n_queries, n_rows = own.count(), int(sizes.sum())
    if not n_queries or not n_rows:
        return own.sparkSession.createDataFrame([], FOUND + ", rank int"), 0.0
    wanted = k + (not include_self)
    begin, parts = _pieces(centres, sizes)
    listed = lambda x: F.get(F.array(*(F.lit(int(c)) for c in x)), F.col("cell"))
    placed = written(index.rows.select("id", "v", (listed(begin) + F.pmod(F.xxhash64("id"), listed(parts))).cast("int").alias("piece")), "pieces")
    held = {r.piece: r["count"] for r in placed.groupBy("piece").count().collect()}  # a row a piece

    def first(d: np.ndarray) -> np.ndarray:
        order = np.argsort(d, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1]

    def among(cells: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([np.arange(begin[c], begin[c] + parts[c]) for c in cells])) if len(cells) else np.zeros(0, np.int64)

    def cells(second: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (whole.iloc[at : at + ASKED] for whole in frames for at in range(0, len(whole), ASKED)):
                d = _to_centres(_vectors(pdf), centres)
                found = []
                for i in range(len(pdf)):
                    near = among(first(d[i]))
                    if second:
                        bound = np.maximum(d[i] - most, least - d[i])
                        tau = pdf["tau"].iloc[i]
                        near = np.setdiff1d(among(np.flatnonzero((bound <= tau * (1 + 1e-9) + 1e-7) & (sizes > 0))), near)
                    found.append(near.astype(np.int32))
                yield pdf[["id", "v"]].assign(tau=pdf["tau"] if second else np.inf, cells=found)

        return run

    def searched(asked: DataFrame) -> tuple[DataFrame, int]:
        asked = written(asked, "asked")
        n = {r.piece: r["count"] for r in asked.select(F.explode("cells").alias("piece")).groupBy("piece").count().collect()}  # a row a piece
        most_queries = _block_rows(n_queries)
        deals = F.get(F.array(*(F.lit(max(1, -(-n.get(c, 0) // most_queries))) for c in range(max(held) + 1))), F.col("piece"))
        key = lambda deal: F.concat_ws("-", "piece", deal).alias("cell")
        left = asked.select("id", "v", "tau", F.explode("cells").alias("piece")).select("id", "v", "tau", F.lit(True).alias("query"), key(F.pmod(F.xxhash64("id"), deals)))
        right = placed.where(F.col("piece").isin(list(n))).select("id", "v", "piece", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal")).select("id", "v", F.lit(0.0).alias("tau"), F.lit(False).alias("query"), key(F.col("deal")))
        return written(left.unionByName(right).groupBy("cell").applyInPandas(_best(k, include_self), FOUND), "found"), sum(held.get(c, 0) * m for c, m in n.items())

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)
    asks = f"id long, v {kind}, tau double, cells array<int>"
    near, n_near = searched(own.mapInPandas(cells(False), asks))
    bound = ranked(near).groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("tau"))
    bounded = own.join(bound, "id", "left").select("id", "v", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    far, n_far = searched(bounded.mapInPandas(cells(True), asks))
    return ranked(near.unionByName(far)), (n_near + n_far) / (n_queries * n_rows)


def similar_pairs(df: DataFrame, most_distance: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All pairs a < b within a distance: a, b, distance, compared block by block."""
    n = max(1, -(-df.count() // BLOCK))
    blocks = _blocks(df, id_col, vector, n).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = blocks.select("id", "v", "block", F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other")).alias("cell"))

    def within(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("id")
        v, ids, block = np.stack(cell["v"].to_numpy()).astype(np.float64), cell["id"].to_numpy(), cell["block"].to_numpy()
        one = len(set(block)) == 1
        if one and cell["cell"].iloc[0].split("-")[0] != cell["cell"].iloc[0].split("-")[1]:
            return pd.DataFrame({"a": [], "b": [], "distance": []}).astype({"a": "int64", "b": "int64", "distance": "float64"})
        out = []
        for at in range(0, len(v), 256):
            part = v[at : at + 256]
            d = (part * part).sum(1)[:, None] + (v * v).sum(1) - 2 * part @ v.T
            i, j = np.nonzero((d <= most_distance**2 + 1e-9) & (np.arange(len(v)) > at + np.arange(len(part))[:, None]) & (one | (block[at : at + 256, None] != block)))
            exact = np.sqrt(((part[i] - v[j]) ** 2).sum(1))
            ok = exact <= most_distance
            out.append(pd.DataFrame({"a": ids[at + i[ok]], "b": ids[j[ok]], "distance": exact[ok]}))
        return pd.concat(out)

    return cells.groupBy("cell").applyInPandas(within, "a long, b long, distance double")


def lsh_buckets(df: DataFrame, id_col: str, vector: str, dims: int, planes: int = 12, tables: int = 8, seed: int = 1) -> DataFrame:
    """id, table, bucket by random hyperplanes: candidates for an approximate search beyond what blocks can do."""
    normals = np.random.default_rng(seed).standard_normal((dims, planes * tables))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                sign = (np.stack(pdf["v"].to_numpy()) @ normals > 0).reshape(len(pdf), tables, planes)
                codes = sign @ (1 << np.arange(planes))
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), tables), "table": np.tile(np.arange(tables), len(pdf)), "bucket": codes.ravel()})

    source = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    return source.mapInPandas(run, "id long, table int, bucket long")


def embedded(docs: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "id", text: str = "text", batch: int = 32) -> DataFrame:
    """id, vector, status of texts. ``model`` is loaded once for each task and turns a list of ``batch`` texts at most
    into rows of numbers; vectors have length 1, and one of zeros stays as it is.

    A null text is 'skipped'. Where the model fails on a batch, its rows are 'error' with the reason and without a
    vector, and the others go on. Repeated rows are embedded each; an empty table gives no rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for pdf in parts:
            own = pdf.assign(vector=None, status="skipped", error=None)
            known = np.flatnonzero(own["text"].notna().to_numpy())
            vectors, status, error = (own[c].to_numpy(dtype=object, copy=True) for c in ("vector", "status", "error"))
            for at in range(0, len(known), batch):
                rows = known[at : at + batch]
                try:
                    v = np.asarray(encode(own["text"].iloc[rows].tolist()), np.float64)
                    if v.ndim != 2 or len(v) != len(rows):
                        raise ValueError(f"{len(rows)} texts gave an array of shape {v.shape}")
                except Exception as e:  # noqa: BLE001  whatever a model raises
                    status[rows], error[rows] = "error", f"{type(e).__name__}: {e}"
                    continue
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = (v / np.where(n > 0, n, 1)).astype(np.float32)
                status[rows] = "embedded"
                for i, row in zip(rows, v, strict=True):
                    vectors[i] = row
            yield pd.DataFrame({"id": own["id"], "vector": vectors, "status": status, "error": error})

    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, vector array<float>, status string, error string")


def packed_floats(vector: Column) -> Column:
    """The little-endian 32-bit floats of a vector as binary, which other stores keep."""

    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(pack, "binary")(vector)


def unpacked_floats(raw: Column) -> Column:
    """The vector that such binary holds."""

    def unpack(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return F.pandas_udf(unpack, "array<float>")(raw)


def plane(df: DataFrame, id_col: str, vector: str, dims: int = 2) -> DataFrame:
    """id and the coordinates of vectors on their first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.where(F.col(vector).isNotNull()).select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    fitted = PCA(k=dims, inputCol="__v", outputCol="__p").fit(rows)
    at = vector_to_array("__p")
    return fitted.transform(rows).select(id_col, *(at[i].alias(f"pc{i + 1}") for i in range(dims)))
