"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all other text, whatever its labels, is unlabelled. Linear
classifiers over hashed words minimise prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]), where l is the
logistic loss; where the second term falls below zero its gradient is turned round, as in the published method.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, ids_sample, one_label, texts_of
from .scratch import drop, table

BUCKETS = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


GRAMS = (4, 5, 6)


class Words:
    """The distinct hashed features of a text: its words, lower case, and their stretches of GRAMS characters.

    Words met before are looked up. With ``only`` (a flag for each bucket) other features are left out.
    """

    MEMO = 300_000

    def __init__(self, only: np.ndarray | None = None) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}
        self.only = only

    def _features(self, word: str) -> tuple[int, ...]:
        parts = {word[i : i + k] for k in GRAMS for i in range(len(word) - k + 1)}
        found = {zlib.crc32(p.encode()) % BUCKETS for p in parts} | {zlib.crc32(f"={word}".encode()) % BUCKETS}
        return tuple(i for i in found if self.only is None or self.only[i])

    def of(self, text: str | None) -> np.ndarray:
        memo, out = self.memo, set()
        if len(memo) > self.MEMO:
            memo.clear()
        for w in set(WORD.findall((text or "").lower())):
            got = memo.get(w)
            if got is None:
                got = memo[w] = self._features(w)
            if got:
                out.update(got)
        return np.fromiter(sorted(out), np.int32, len(out))


@dataclass
class LinearPU:
    """Averaged linear classifiers: weights by bucket and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[buckets].sum(dtype=np.float64) + self.bias, -30, 30))))


#: Classifiers, the share of the rows that each is fitted on, and the features that each uses at most.
MEMBERS, SHARE, MOST_FEATURES = 5, 0.8, 512
#: A row's set of labels, and bits that tell which classifiers are fitted on it.
SAMPLE = "doc_id long, label int, members int, buckets array<int>"


def _fit_one(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, features: np.ndarray, epochs: int = 400, rate: float = 0.05, decay: float = 2e-6) -> tuple[np.ndarray, float]:
    index = np.full(BUCKETS, -1, np.int32)
    index[features] = np.arange(len(features))

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = [x[x >= 0] for x in (index[d] for d in docs)]
        return np.repeat(np.arange(len(docs)), [len(x) for x in own]), np.concatenate([*own, np.zeros(0, np.int32)])

    (pr, pc), (ur, uc) = rows(pos), rows(unl)
    n = len(features)
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, epochs + 1):
        fp, fu = np.bincount(pr, w[pc], len(pos)) + b, np.bincount(ur, w[uc], len(unl)) + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        keep = negative >= 0
        dp = (-prior * sig(-fp) - prior * sig(fp)) / len(pos) if keep else prior * sig(fp) / len(pos)
        du = sig(fu) / len(unl) * (1 if keep else -1)
        g = np.append(np.bincount(pc, dp[pr], n) + np.bincount(uc, du[ur], n) + decay * w, dp.sum() + du.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def sampled(docs: DataFrame, ids: DataFrame, seed: int = 3) -> DataFrame:
    """SAMPLE of the ids (doc_id, label), each once for a label: of several texts of one id the greatest is read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([words.of(t) for t in part.column(3).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "label", "members", "buckets"])

    draws = [F.pmod(F.xxhash64("doc_id", F.lit(seed + k)), F.lit(1000)) < int(1000 * SHARE) for k in range(MEMBERS)]
    members = sum((F.when(d, 1 << k).otherwise(0) for k, d in enumerate(draws)), F.lit(0))
    one = texts_of(docs, ids).groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    return one.select("doc_id", "label", members.cast("int").alias("members"), "text").mapInArrow(encode, SAMPLE)


def _shares(sample: DataFrame) -> DataFrame:
    """bucket, label, member, n: the rows of each classifier that have the bucket; MEMBERS stands for all rows. Each task
    adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, MEMBERS + 1, BUCKETS), np.int32)
        for batch in batches:
            for label, members, buckets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = buckets.values.to_numpy(zero_copy_only=False)
                for k in [k for k in range(MEMBERS) if members >> k & 1] + [MEMBERS]:
                    counts[label, k, own] += 1
        label, member, bucket = np.nonzero(counts)
        for at in range(0, len(label), 100_000):
            own = [x[at : at + 100_000] for x in (bucket, label, member)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in own), pa.array(counts[own[1], own[2], own[0]], pa.int64())], ["bucket", "label", "member", "n"])

    return sample.select("label", "members", "buckets").mapInArrow(run, "bucket int, label int, member int, n long").groupBy("bucket", "label", "member").agg(F.sum("n").alias("n"))


def _features(counts: DataFrame, member: int, n_pos: int, n_unl: int, prior: float) -> DataFrame:
    """The buckets whose share among the positives stands out most above their share among the unlabelled."""
    own = counts.where(F.col("member") == member).groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in ((1, "cp"), (0, "cu"))))
    p, u = F.col("cp") / n_pos, F.col("cu") / n_unl
    z = (p - u) / F.sqrt((F.col("cp") + 1) / n_pos**2 + (F.col("cu") + 1) / n_unl**2)
    # prior * p / u: the share of toxic texts among those with the feature
    found = own.where((F.col("cp") >= 3) & (prior * p >= 0.6 * u)).withColumn("z", z).where("z > 2.5")
    return found.orderBy(F.col("z").desc(), "bucket").limit(MOST_FEATURES).select(F.lit(member).alias("member"), "bucket")


def fit(sample: DataFrame, prior: float) -> LinearPU:
    """Mean of classifiers, each fitted on a different four fifths of the sample (a written table of SAMPLE).

    Features are counted and chosen by grouped sums; what comes to the driver is MEMBERS * MOST_FEATURES buckets, and of
    each row of the sample those that it has.
    """
    weights, bias = np.zeros(BUCKETS), 0.0
    size = {(r.label, r.members): r["count"] for r in sample.groupBy("label", "members").count().collect()}  # 16 rows at most
    n = [[sum(c for (of, m), c in size.items() if of == label and (k == MEMBERS or m >> k & 1)) for k in range(MEMBERS + 1)] for label in (0, 1)]
    if not n[0][MEMBERS] or not n[1][MEMBERS]:
        return LinearPU(weights.astype(np.float32), -1.0)
    counts = table(_shares(sample), "shares")
    of = [k if n[0][k] and n[1][k] else MEMBERS for k in range(MEMBERS)]
    chosen = None
    for k in sorted(set(of)):
        one = _features(counts, k, n[1][k], n[0][k], prior)
        chosen = one if chosen is None else chosen.unionByName(one)
    features: dict[int, list[int]] = {k: [] for k in of}
    for r in chosen.collect():
        features[r.member].append(r.bucket)
    wanted = np.unique(np.array([b for own in features.values() for b in own], np.int32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(x := b.values.to_numpy(zero_copy_only=False))[np.isin(x, wanted)].tobytes() for b in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary())], ["doc_id", "label", "members", "rows"])

    rows = sorted((r.label, r.doc_id, r.members, bytes(r.rows)) for r in sample.mapInArrow(cut, "doc_id long, label int, members int, rows binary").collect())
    drop(counts)
    for k in of:
        pos, unl = ([np.frombuffer(x, np.int32) for is_of, _, m, x in rows if is_of == label and (k == MEMBERS or m >> k & 1)] for label in (1, 0))
        own = np.sort(np.array(features[k], np.int32))
        w, b = _fit_one(pos, unl, prior, own)
        weights[own] += w / MEMBERS
        bias += b / MEMBERS
    return LinearPU(weights.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most_positive: int = 2000, most_unlabelled: int = 4000) -> LinearPU:
    """Fit on at most ``most_positive`` toxic documents and ``most_unlabelled`` others, all outside the held-out fold.

    Documents are ids: however many rows an id has, it is drawn once and one text of it is read. The class prior is the
    share of toxic rows among labelled rows there. Without toxic rows all scores are low.
    """
    known = one_label(labels, "toxic").where(fold("doc_id", folds) != held_out)
    toxic, n = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    prior = float(np.clip(toxic / max(n, 1), 0.01, 0.5))
    positive = ids_sample(known.where("label = 1"), most_positive, 3)
    other = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(fold("doc_id", folds) != held_out).distinct().withColumn("label", F.lit(0))
    unlabelled = ids_sample(other, most_unlabelled, 5)
    sample = table(sampled(docs, positive.unionByName(unlabelled)), "sample")
    model = fit(sample, prior)
    drop(sample)
    return model


def score_documents(docs: DataFrame, model: LinearPU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row, by its whole text; null texts are empty."""
    used = np.flatnonzero(model.weights).astype(np.int32)
    values, bias = model.weights[used], model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BUCKETS, np.float32)
        weights[used] = values
        own, words = LinearPU(weights, bias), Words(weights != 0)
        for batch in batches:
            got = [own.score(words.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from the threshold on).

    Null texts count as empty; texts of any length are read whole; equal texts get equal scores, repeated rows a result
    each; a null id is held out of nothing; other columns are ignored, whatever their names; an empty table gives an empty
    result, and without toxic labels all scores are low.
    """
    scored = score_documents(docs, train(docs, labels, folds, held_out))
    return scored.select("doc_id", (F.coalesce(fold("doc_id", folds), F.lit(-1)) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
