"""The fit of the toxicity classifier: bounded, and its risk and scores against plain loops."""

import math
import re
import zlib

import numpy as np
import pytest

from quillon.llm import toxicity

WORD = re.compile(r"[^\W\d_]+")


def features(text):
    found = set()
    for w in WORD.findall((text or "").lower()):
        found |= {w[i : i + k] for k in (4, 5, 6) for i in range(len(w) - k + 1)} | {f"={w}"}
    return {zlib.crc32(x.encode()) % toxicity.BUCKETS for x in found}


def test_rows_of_one_id_are_drawn_once(spark):
    rows = [(1, f"text {i}", "x") for i in range(300)] + [(i, "other words", "x") for i in range(2, 9)] + [(None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    ids = spark.createDataFrame([(i, k) for i in range(1, 9) for k in (0, 1)], "doc_id long, label int")
    got = toxicity.sampled(docs, ids).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(i, k) for i in range(1, 9) for k in (0, 1)]
    assert all(set(r.buckets) == features("text 99" if r.doc_id == 1 else "other words") for r in got)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == len(rows)


def test_features_are_those_that_stand_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 == 0), 1 | int(rng.integers(0, 2)) << 1, sorted(rng.choice(60, 12, replace=False).tolist() + ([99] if i % 3 == 0 else []))) for i in range(90)]
    sample = spark.createDataFrame(rows, toxicity.SAMPLE).repartition(3)
    counts = toxicity._shares(sample)
    for member in (0, 1):
        own = [r for r in rows if r[2] >> member & 1]
        n = [sum(r[1] == k for r in own) for k in (0, 1)]
        want = []
        for b in range(100):
            cu, cp = (sum(b in r[3] for r in own if r[1] == k) for k in (0, 1))
            p, u = cp / n[1], cu / n[0]
            z = (p - u) / math.sqrt((cp + 1) / n[1] ** 2 + (cu + 1) / n[0] ** 2)
            if cp >= 3 and 0.3 * p >= 0.6 * u and z > 2.5:
                want.append((-z, b))
        assert [r.bucket for r in toxicity._features(counts, member, n[1], n[0], 0.3).collect()] == [b for _, b in sorted(want)] and want


@pytest.mark.parametrize("prior", [0.05, 0.4])
def test_gradient_follows_the_non_negative_risk(prior):
    """One step from zero moves each weight against the derivative of the risk, taken by differences."""
    rng = np.random.default_rng(5)
    pos, unl = ([np.flatnonzero(rng.random(6) < q).astype(np.int32) for _ in range(12)] for q in (0.6, 0.3))
    loss = lambda z: math.log1p(math.exp(-z))
    f = lambda w, x: w[6] + sum(w[i] for i in x)

    def risk(w):
        negative = sum(loss(-f(w, x)) for x in unl) / len(unl) - prior * sum(loss(-f(w, x)) for x in pos) / len(pos)
        return (prior * sum(loss(f(w, x)) for x in pos) / len(pos) + negative) if negative >= 0 else -negative

    w, b = toxicity._fit_one(pos, unl, prior, np.arange(6), epochs=1, rate=0.01, decay=0.0)
    for i in range(7):
        up, down = np.zeros(7), np.zeros(7)
        up[i], down[i] = 1e-5, -1e-5
        slope = (risk(up) - risk(down)) / 2e-5
        assert abs(slope) < 1e-7 or np.sign(-slope) == np.sign([*w, b][i])


def test_scores_are_sums_of_weights(spark):
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    rng = np.random.default_rng(1)
    texts = ["Some toxic words here", "", None, "Wörter größer 123 mixed-case", "long " * 4000, "same", "same"]
    for t in texts:
        for i in list(features(t))[::2]:
            weights[i] = rng.normal()
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, toxicity.LinearPU(weights, -0.5)).collect()}
    for i, t in enumerate(texts):
        z = sum(float(weights[k]) for k in features(t)) - 0.5
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-5)
