"""Dips against their definition, violins against plain numpy."""

import numpy as np
import pytest

from quillon.operators import shape


def fits(x, below, upto, d):
    """Is there a distribution function within d, convex up to some value and concave from it on?"""

    def left(x, low, high, m):
        # Of a convex function between low and high: the least value at m, or None if there is none.
        n = len(x)
        for j in range(n):
            for i in range(j):
                for k in range(j + 1, n):
                    if low[j] > high[i] + (high[k] - high[i]) * (x[j] - x[i]) / (x[k] - x[i]) + 1e-12:
                        return None
        lines = [low[j] + (low[j] - high[i]) / (x[j] - x[i]) * (m - x[j]) for j in range(n) for i in range(j)]
        return max([*lines, *low[-1:]])

    for at in range(len(x)):
        low, high = upto[:at] - d, below[:at] + d
        a = left(x[:at], low, high, x[at]) if at else -np.inf
        mirrored = slice(None, at, -1)
        b = left(-x[mirrored], -(below[mirrored] + d), -(upto[mirrored] - d), -x[at]) if at < len(x) - 1 else -np.inf
        if a is None or b is None or (low > high + 1e-12).any() or (upto[at + 1 :] - d > below[at + 1 :] + d + 1e-12).any():
            continue
        # The chord to a point at the mode must pass below the upper band before it, and above the lower band behind it.
        least, most = max(a, below[at] - d), min(-b, upto[at] + d)
        if least <= below[at] + d + 1e-12 and most >= upto[at] - d - 1e-12 and least <= most + 1e-12:
            return True
    return False


def by_definition(sample):
    x, c = np.unique(sample, return_counts=True)
    upto = np.cumsum(c) / len(sample)
    below, lo, hi = upto - c / len(sample), 0.0, 0.5
    for _ in range(40):
        d = (lo + hi) / 2
        lo, hi = (lo, d) if fits(x, below, upto, d) else (d, hi)
    return hi


SAMPLES = {
    "grid": list(range(1, 12)),
    "two": [0.0] * 5 + [1.0] * 5,
    "bimodal": [0, 0.1, 0.2, 0.25, 0.3, 5, 5.1, 5.15, 5.3, 5.4],
    "skew": [1, 1, 1, 1, 2, 2, 3, 4, 7, 12],
    "three": [0, 0.1, 0.2, 4, 4.05, 4.1, 9, 9.1, 9.3],
    None: [3.0, 1.0, 2.0, 2.5],
}


def test_dips_by_definition(spark):
    rng = np.random.default_rng(3)
    samples = SAMPLES | {f"r{k}": np.round(rng.normal(size=11) + 3 * (rng.random(11) < 0.5), 1).tolist() for k in range(6)}
    data = [(g, float(v)) for g, own in samples.items() for v in own] + [("grid", None), ("grid", float("nan")), ("empty", None)]
    got = {r.g: r for r in shape.dips(spark.createDataFrame(data, "g string, v double").repartition(5), "g", "v").collect()}
    assert set(got) == set(samples)
    for g, own in samples.items():
        assert got[g].n == len(own)
        assert got[g].dip == pytest.approx(max(by_definition(own), 0.5 / len(own)), abs=1e-6), g
    # Known: no distribution dips more than a quarter, which two equal points do; an even grid dips half a row.
    assert got["two"].dip == 0.25 and got["grid"].dip == pytest.approx(1 / 22) and got["grid"].p_value > 0.9 and got["bimodal"].p_value < 0.05


def test_dips_of_a_large_group_by_ranges(spark):
    rng = np.random.default_rng(5)
    one, two = rng.normal(size=4000), np.concatenate([rng.normal(size=2000), 4 + rng.normal(size=2000)])
    data = [("one", float(v)) for v in one] + [("two", float(v)) for v in two]
    got = {r.g: r for r in shape.dips(spark.createDataFrame(data, "g string, v double").repartition(7), "g", "v").collect()}
    for g, own in (("one", one), ("two", two)):
        assert got[g].dip == pytest.approx(shape._dip(own) / (2 * len(own)), abs=1e-12)
    assert got["one"].p_value > 0.2 and got["two"].p_value < 0.01
    none = spark.createDataFrame([], "g string, v double")
    assert shape.dips(none, "g", "v").count() == shape.violins(none, "g", "v").count() == 0


def test_violins(spark):
    rng = np.random.default_rng(8)
    own = np.round(rng.normal(size=200), 2)
    data = [("a", float(v)) for v in own] + [("flat", 2.0)] * 3 + [(None, 1.0), (None, 4.0), ("a", None)]
    got = {r.g: r for r in shape.violins(spark.createDataFrame(data, "g string, v double"), "g", "v", 11).collect()}
    assert set(got) == {"a", "flat", None}
    a, width = got["a"], own.std(ddof=1) * 200**-0.2
    grid = np.linspace(own.min(), own.max(), 11)
    want = np.exp(-(((grid[:, None] - own) / width) ** 2) / 2).sum(1) / (200 * width * (2 * np.pi) ** 0.5)
    assert (a.n, a.mean, a.median, a.least, a.most) == pytest.approx((200, own.mean(), np.median(own), own.min(), own.max()))
    assert np.allclose([p.x for p in a.points], grid) and np.allclose([p.density for p in a.points], want)
    assert [p.density for p in got["flat"].points] == [None] * 11 and got[None].median == 2.5
