"""The shape of a distribution: the dip from unimodality, and the figures that a violin is drawn from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.relational import exact_quantiles
from quillon.storage import discard, written

#: Uniform samples that a p-value is judged by, and the most values of one.
DRAWS = 200
DRAW_SIZE = 500


def _hull(x: np.ndarray, y: np.ndarray, lower: bool) -> np.ndarray:
    """Places of the vertices of the greatest convex minorant (or the least concave majorant) of points by rising x."""
    sign, kept = (1 if lower else -1), []
    for i in range(len(x)):
        while len(kept) > 1 and sign * ((y[kept[-1]] - y[kept[-2]]) * (x[i] - x[kept[-1]]) - (y[i] - y[kept[-1]]) * (x[kept[-1]] - x[kept[-2]])) >= 0:
            kept.pop()
        kept.append(i)
    return np.array(kept, dtype=int)


def _interval(gx: np.ndarray, gy: np.ndarray, lx: np.ndarray, ly: np.ndarray) -> tuple[float, float, float]:
    """The greatest distance of the minorant's vertices (g) and the majorant's (l), and the modal interval that it gives."""
    at_g, at_l = np.interp(gx, lx, ly) - gy, ly - np.interp(lx, gx, gy)
    i, j = int(at_g.argmax()), int(at_l.argmax())
    if at_g[i] > at_l[j]:
        return float(at_g[i]), float(gx[i]), float(lx[np.searchsorted(lx, gx[i])])
    return float(at_l[j]), float(gx[np.searchsorted(gx, lx[j], side="right") - 1]), float(lx[j])


def _dip(x: np.ndarray) -> float:
    """The dip of a sample in one process, in rows, as ``dips`` finds it by rounds."""
    x, counts = np.unique(x, return_counts=True)
    upto = np.cumsum(counts).astype(float)
    below, dip = upto - counts, 1.0
    lo, hi = 0, len(x) - 1
    while True:
        own = slice(lo, hi + 1)
        g, h = lo + _hull(x[own], below[own], True), lo + _hull(x[own], upto[own], False)
        d, a, b = _interval(x[g], below[g], x[h], upto[h])
        if d <= dip:
            return dip
        a, b = int(np.searchsorted(x, a)), int(np.searchsorted(x, b))
        left, right = slice(lo, a), slice(b + 1, hi + 1)
        dip = max([dip, *(upto[left] - np.interp(x[left], x[g], below[g])), *(np.interp(x[right], x[h], upto[h]) - below[right])])
        if (a, b) == (lo, hi):
            return dip
        lo, hi = a, b


def _steps(df: DataFrame, group: str, value: str) -> DataFrame:
    """g, x, below, upto, part: how many rows of a group lie below each of its values, and up to it. Rows are ordered by
    range partitions, in which ranks are counted; so a large group is spread over many tasks."""
    own = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counted = own.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    ranged = written(counted.repartitionByRange("g", "x").withColumn("part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("g", "part").agg(F.sum("c").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy("g").orderBy("part")) - F.col("c")).drop("c")
    within = F.sum("c").over(Window.partitionBy("g", "part").orderBy("x"))
    ranked = ranged.withColumn("within", within).join(before.withColumnRenamed("g", "bg").withColumnRenamed("part", "bp"), F.col("g").eqNullSafe(F.col("bg")) & (F.col("part") == F.col("bp")))
    out = written(ranked.select("g", "x", (F.col("before") + F.col("within") - F.col("c")).cast("double").alias("below"), (F.col("before") + F.col("within")).cast("double").alias("upto"), "part"), "steps")
    discard(ranged)
    return out


def dips(df: DataFrame, group: str, value: str, seed: int = 1) -> DataFrame:
    """Hartigan's dip of each group: group, n, dip, p_value. Values that are null or no number do not count; groups
    without values are left out, and a null group is one of its own.

    The greatest convex minorant and the least concave majorant of the distribution are found in each range of values and
    put together from the ranges' vertices, of which there are few; they bound the modal interval of the next round, and
    the distance from them outside of it is the dip so far; equal values at its ends may be a jump. Rounds end when nothing within is farther. ``p_value`` is the
    share of DRAWS uniform samples, of DRAW_SIZE values at most, whose dip times the root of their size is no smaller.
    """
    steps = _steps(df, group, value)
    kind = dict(steps.dtypes)["g"]
    groups = steps.groupBy("g").agg(F.max("upto").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = written(groups.withColumn("dip", F.lit(1.0)).withColumn("done", F.lit(False)), "dips")

    def vertices(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, below, upto = (pdf[c].to_numpy() for c in ("x", "below", "upto"))
        low, high = _hull(x, below, True), _hull(x, upto, False)
        at = np.concatenate([low, high])
        return pd.DataFrame({"g": pdf["g"].iloc[at].to_numpy(), "lower": np.arange(len(at)) < len(low), "x": x[at], "y": np.concatenate([below[low], upto[high]])})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        hulls = []
        for lower in (True, False):
            own = pdf[pdf["lower"] == lower]
            x, y = own["x"].to_numpy(), own["y"].to_numpy()
            at = _hull(x, y, lower)
            hulls += [x[at], y[at]]
        d, a, b = _interval(*hulls)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "d": [d], "a": [a], "b": [b], "gx": [hulls[0]], "gy": [hulls[1]], "lx": [hulls[2]], "ly": [hulls[3]]})

    def outside(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x, below, upto = (pdf[c].to_numpy() for c in ("x", "below", "upto"))
        left, right = x < first["a"], x > first["b"]
        far = [1.0]
        if left.any():
            far.append((upto[left] - np.interp(x[left], first["gx"], first["gy"])).max())
        if right.any():
            far.append((np.interp(x[right], first["lx"], first["ly"]) - below[right]).max())
        return pd.DataFrame({"g": [first["g"]], "far": [max(far)]})

    def matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return left.join(right.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g")), how).drop("__g")

    while not state.where("not done").isEmpty():
        inside = written(matched(steps, state.where("not done").select("g", "lo", "hi")).where("x >= lo and x <= hi"), "inside")
        hulls = inside.groupBy("g", "part").applyInPandas(vertices, f"g {kind}, lower boolean, x double, y double")
        whole = written(hulls.groupBy("g").applyInPandas(joined, f"g {kind}, d double, a double, b double, gx array<double>, gy array<double>, lx array<double>, ly array<double>"), "hulls")
        # Only the parts outside of the new interval are compared with the hulls, each part beside one copy of them.
        far = matched(inside, whole).where("x < a or x > b").groupBy("g", "part").applyInPandas(outside, f"g {kind}, far double").groupBy("g").agg(F.max("far").alias("far"))
        found = matched(whole.select("g", "d", "a", "b"), far, "left").na.fill(1.0, ["far"])
        moved = matched(state, found, "left").withColumn("better", F.coalesce(F.col("d") > F.col("dip"), F.lit(False)))
        step = moved.select(
            "g", "n",
            F.when(F.col("better"), F.col("a")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("better"), F.col("b")).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("better"), F.greatest("dip", "far")).otherwise(F.col("dip")).alias("dip"),
            (F.col("done") | ~F.col("better") | ((F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi")))).alias("done"),
        )
        after = written(step, "dips")
        discard(state, inside, whole)
        state = after

    def judged(parts):
        seen: dict[int, np.ndarray] = {}
        for pdf in parts:
            out = []
            for n, dip in zip(pdf["n"], pdf["dip"], strict=True):
                m = int(min(n, DRAW_SIZE))
                if m not in seen:
                    rng = np.random.default_rng([seed, m])
                    seen[m] = np.sort([_dip(rng.random(m)) for _ in range(DRAWS)]) / (2 * m**0.5)
                # A tie of figures that are computed in different orders is a tie.
                out.append(1 - np.searchsorted(seen[m], dip / (2 * n**0.5) * (1 - 1e-9)) / DRAWS)
            yield pd.DataFrame({"g": pdf["g"], "n": pdf["n"].astype("int64"), "dip": pdf["dip"] / (2 * pdf["n"]), "p_value": out})

    return state.select("g", "n", "dip").mapInPandas(judged, f"g {kind}, n long, dip double, p_value double").withColumnRenamed("g", group)


def violins(df: DataFrame, group: str, value: str, points: int = 100) -> DataFrame:
    """What a violin of each group is drawn from: group, n, mean, median, least, most, and the ``points`` (x, density) of a
    Gaussian kernel with Scott's width, from the least value to the greatest.

    Densities are sums over distinct values, added up before they are shuffled. A group of one value, or of values that
    are all equal, has no width: its points have a null density.
    """
    own = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counted = own.groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    figures = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), F.stddev_samp("x").alias("sd"))
    width = F.when(F.col("sd") > 0, F.col("sd") * F.pow("n", F.lit(-0.2)))
    figures = written(figures.withColumn("width", width).withColumnRenamed("g", "__g"), "figures")
    middle = exact_quantiles(own, "g", "x", [0.5]).select(F.col("g").alias("__m"), F.get("quantiles", F.lit(0)).alias("median"))
    at = F.col("least") + (F.col("most") - F.col("least")) * F.col("i") / (points - 1)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    spread = counted.join(figures, F.col("g").eqNullSafe(F.col("__g"))).select("g", "x", "c", "n", "least", "most", "width", grid)
    z = (at - F.col("x")) / F.col("width")
    density = F.sum(F.col("c") * F.exp(-z * z / 2) / (F.col("n") * F.col("width") * (2 * np.pi) ** 0.5))
    curve = spread.groupBy("g", "i").agg(F.first(at).alias("at"), density.alias("density"))
    listed = curve.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "at", "density"))), lambda p: F.struct(p["at"].alias("x"), p["density"].alias("density"))).alias("points"))
    out = listed.join(figures, F.col("g").eqNullSafe(F.col("__g"))).join(middle, F.col("g").eqNullSafe(F.col("__m")))
    return out.select(F.col("g").alias(group), "n", "mean", "median", "least", "most", "points")
