"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from how its classes of bytes follow each other; gated
attention weighs the encoded passages, and the weighted sum is scored. Only documents carry labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, ids_sample, one_label, texts_of

#: Bytes of a passage.
PASSAGE = 512
CLASSES = 16
LAGS = range(2, 18)
DIMS = CLASSES**2 + len(LAGS) + 2


def _byte_classes() -> np.ndarray:
    table = np.full(256, 15, np.int64)
    groups = [range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",;:", b"!?", b"|", b"%$#&*@^~=+", b"-_/\\", b"'\"`", b"()[]{}<>", range(128, 192), range(192, 256)]
    for k, group in enumerate(groups):
        table[list(group)] = k
    return table


BYTE_CLASS = _byte_classes()


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features, one for each passage of every text, and the text that each belongs to.

    The whole text counts. An empty or null text has one passage without bytes.
    """
    data = [(t or "").encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    per_text = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(data)), per_text)
    total = int(per_text.sum())
    raw = np.frombuffer(b"".join(data), np.uint8)
    begins = np.cumsum(sizes) - sizes
    at = np.arange(len(raw)) - np.repeat(begins, sizes)
    row = np.repeat(np.cumsum(per_text) - per_text, sizes) + at // PASSAGE
    kind = BYTE_CLASS[raw]
    inside = np.flatnonzero(at[1:] > 0) + 1  # pairs within a text
    pairs = np.bincount(row[inside] * CLASSES**2 + kind[inside - 1] * CLASSES + kind[inside], minlength=total * CLASSES**2).reshape(total, -1)
    n = np.maximum(pairs.sum(1, keepdims=True), 1)
    # Bytes that are as they were k bytes before: stretches that come again.
    again = [np.bincount(row[k:][(at[k:] >= k) & (raw[k:] == raw[:-k])], minlength=total) for k in LAGS]
    shares = np.hstack([np.sqrt(pairs / n), 3 * np.sort(np.stack(again, 1) / n, 1)[:, ::-1]])
    return np.hstack([shares, np.minimum(n, PASSAGE) / PASSAGE, np.ones_like(n)]).astype(np.float32), owner


@dataclass
class AttentionModel:
    """Encoder W, gate V and U, attention w, score c."""

    W: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray

    @classmethod
    def random(cls, dims: int, hidden: int = 24, gate: int = 16, seed: int = 7) -> AttentionModel:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        return cls(draw(dims, hidden), draw(hidden, gate), draw(hidden, gate), draw(gate, 1), draw(hidden + 1, 1))

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        h = np.tanh(x @ self.W)
        t, s = np.tanh(h @ self.V), 1 / (1 + np.exp(-np.clip(h @ self.U, -30, 30)))
        e = (t * s @ self.w)[:, 0]
        top = np.full(bags, -np.inf, np.float32)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, bags)[bag]
        starts = np.searchsorted(bag, np.arange(bags))
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        f = z @ self.c[:-1, 0] + self.c[-1, 0]
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "f": f, "starts": starts}

    def scores(self, x: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, bag, bags)["f"].astype(np.float64), -30, 30)))

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        got = self.forward(x, bag, len(y))
        h, t, s, a, z = (got[k] for k in "htsaz")
        df = ((1 / (1 + np.exp(-np.clip(got["f"], -30, 30))) - y) / len(y)).astype(np.float32)
        dc = np.append(z.T @ df, df.sum())[:, None]
        dz = df[:, None] * self.c[:-1, 0]
        pull = (h * dz[bag]).sum(1)
        de = a * (pull - np.add.reduceat(a * pull, got["starts"])[bag])
        dw = (t * s).T @ de[:, None]
        dg = de[:, None] * self.w[:, 0]
        dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ self.V.T + ds @ self.U.T
        return [x.T @ (dh * (1 - h**2)), h.T @ dt, h.T @ ds, dw, dc]


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the log loss. ``bag`` is sorted and numbers the labels' bags from 0."""
    model = AttentionModel.random(x.shape[1], seed=seed)
    params = [model.W, model.V, model.U, model.w, model.c]
    if not len(y):
        return model
    base = np.clip(y.mean(), 0.01, 0.99)
    model.c[-1] = np.log(base / (1 - base))
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    starts = np.append(np.searchsorted(bag, np.arange(len(y))), len(bag))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
            within = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])
            step += 1
            for p, g, mi, vi in zip(params, model.gradients(x[rows], within, y[own].astype(np.float32)), m, v, strict=True):
                g = g + decay * p
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = 4000, most_passages: int = 48) -> AttentionModel:
    """Fit on at most ``most`` labelled documents outside the held-out fold, each by ``most_passages`` evenly spaced
    passages at most; scoring reads all passages. Without labelled rows the model is untrained."""
    known = one_label(labels, "quality").where(fold("doc_id", folds) != held_out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x, owner = passages(part.column(2).to_pylist())
                rows = []
                for i in range(part.num_rows):
                    own = np.flatnonzero(owner == i)
                    if len(own) > most_passages:
                        own = own[np.linspace(0, len(own) - 1, most_passages).astype(int)]
                    rows.append(x[own].astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], ["doc_id", "label", "rows"])

    sample = texts_of(docs, ids_sample(known, most, 8)).select("doc_id", "label", "text").dropDuplicates(["doc_id"])
    got = sorted((r.doc_id, r.label, bytes(r.rows)) for r in sample.mapInArrow(encode, "doc_id long, label int, rows binary").collect())
    xs = [np.frombuffer(r, np.float16).reshape(-1, DIMS).astype(np.float32) for *_, r in got]
    bag = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    return fit(np.vstack(xs) if xs else np.zeros((0, DIMS), np.float32), bag, np.array([y for _, y, _ in got], np.float32))


def score_documents(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row, by its whole text; null texts are empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                x, owner = passages(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(x, owner, part.num_rows), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, score double")


def good_documents(docs: DataFrame, model: AttentionModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``threshold`` or more, with all their columns, whatever their names.

    Null and empty texts score as one passage without bytes; texts of any length are read whole; equal texts, and so
    repeated rows, stay or go together, and rows with a null id are judged like others. An empty table gives an empty result.
    """
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                x, owner = passages(part.column(text).to_pylist())
                yield part.filter(pa.array(model.scores(x, owner, part.num_rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from the threshold on).

    Null texts count as empty; texts of any length are read whole, passage by passage; equal texts get equal scores,
    repeated rows a result each; a null id is held out of nothing; other columns are ignored, whatever their names; an
    empty table gives an empty result, and without labels to learn from scores mean nothing.
    """
    scored = score_documents(docs, train(docs, labels, folds, held_out))
    return scored.select("doc_id", (F.coalesce(fold("doc_id", folds), F.lit(-1)) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
