"""Operators on series keyed by time: baselines, zero filling, escalation scores, technical indicators, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BASELINE = 10


def trailing_anomalies(series: DataFrame, keys: Sequence[str], time: str, value: str, baseline: int = 30, threshold: float = 2.0, direction: str = "both", least: float | None = 0.0, latest_only: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Points far from the rows before them: keys, time, value, mean, std, z, pct, and the columns to ``carry``.

    Null values go first. The baseline is up to ``baseline`` rows (not days) strictly before a point, of which ten are
    needed; points below ``least`` and flat baselines are passed over. Thresholds are inclusive.
    """
    order = Window.partitionBy(*keys).orderBy(time)
    before = order.rowsBetween(-baseline, -1)
    x = F.col(value)
    out = series.where(x.isNotNull()).select(*keys, time, value, *carry)
    if latest_only:
        out = out.withColumn("__last", F.lead(time).over(order).isNull())
    out = out.withColumn("n", F.count(value).over(before)).withColumn("mean", F.avg(value).over(before)).withColumn("std", F.stddev_samp(value).over(before))
    out = out.where((F.col("n") >= LEAST_BASELINE) & (F.col("std") > 0))
    if least is not None:
        out = out.where(x >= least)
    if latest_only:
        out = out.where("__last")
    out = out.withColumn("z", (x - F.col("mean")) / F.col("std"))
    out = out.withColumn("pct", F.when(F.col("mean") != 0, (x - F.col("mean")) / F.col("mean") * 100).otherwise(F.lit(0.0)))
    z = F.col("z")
    test = {"both": F.abs(z) >= threshold, "surge": z >= threshold, "drop": z <= -threshold}[direction]
    return out.where(test).select(*keys, time, value, "mean", "std", "z", "pct", *carry)


def calendar(keys: DataFrame, start: Column, end: Column, name: str = "day") -> DataFrame:
    """Every day from start to end (inclusive) for each row of keys."""
    return keys.withColumn(name, F.explode(F.sequence(start, end, F.expr("interval 1 day"))))


def zero_filled(series: DataFrame, keys: Sequence[str], day: str, value: str, start: Column, end: Column) -> DataFrame:
    """The series with a row for every day; days without one have 0."""
    days = calendar(series.select(*keys).distinct(), start, end, day)
    return days.join(series.select(*keys, day, value), [*keys, day], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def _clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def hotspots(daily: DataFrame, key: str, as_of: Column, window_days: int = 14, baseline_days: int = 90, least_events: int = 30, least_days: int = 14, rounded: bool = True) -> DataFrame:
    """Escalation of each key's last days against its own baseline, both before ``as_of`` (exclusive).

    ``daily`` has key, day, n, n4 (material conflict), g_sum, g_n. Days without rows count as 0 in the daily material
    counts, which needs no calendar: sums and sums of squares over the days with rows, divided by the days of the span.
    """
    start = F.date_sub(as_of, window_days)
    base = F.date_sub(start, baseline_days)
    day = F.col("day")
    inside = daily.where((day >= base) & (day < as_of) & F.col(key).isNotNull())
    w = day >= start
    own = lambda c, cond: F.sum(F.when(cond, F.col(c)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    agg = inside.groupBy(key).agg(
        zero(own("n", w)).alias("n_w"),
        zero(own("n", ~w)).alias("n_b"),
        zero(own("n4", w)).alias("n4_w"),
        zero(own("n4", ~w)).alias("n4_b"),
        zero(F.sum(F.when(~w, F.col("n4") * F.col("n4")))).alias("n4_sq"),
        zero(own("g_sum", w)).alias("g_w"),
        zero(own("g_sum", ~w)).alias("g_b"),
        zero(own("g_n", w)).alias("gn_w"),
        zero(own("g_n", ~w)).alias("gn_b"),
        F.count(F.when(~w, 1)).alias("days_b"),
    )
    agg = agg.where((F.col("n_w") >= least_events) & (F.col("days_b") >= least_days))
    n = float(baseline_days)
    c = F.col
    mean_b, mean_w = c("n4_b") / n, c("n4_w") / float(window_days)
    var = (c("n4_sq") - c("n4_b") * c("n4_b") / n) / (n - 1)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    # Whole counts: a flat baseline has a variance of 0 but for rounding.
    z = F.when(var > 1e-9, (mean_w - mean_b) / std).when(mean_w > mean_b, 4.0).otherwise(0.0)
    ratio = lambda a, b, other: F.when(b > 0, a / b).otherwise(F.lit(other))
    out = agg.select(
        key,
        c("n_w").cast("long").alias("window_events"),
        (c("n_b") / n).alias("baseline_daily_events"),
        (c("n_w") / float(window_days)).alias("window_daily_events"),
        z.alias("material_z"),
        ratio(c("n4_w"), c("n_w"), 0.0).alias("material_share_window"),
        ratio(c("n4_b"), c("n_b"), 0.0).alias("material_share_baseline"),
        ratio(c("g_w"), c("gn_w"), 0.0).alias("goldstein_window"),
        ratio(c("g_b"), c("gn_b"), 0.0).alias("goldstein_baseline"),
    )
    volume = ratio(c("window_daily_events"), c("baseline_daily_events"), 1.0)
    score = (
        0.35 * _clip01(c("material_z") / 4)
        + 0.25 * _clip01((c("material_share_window") - c("material_share_baseline")) * 2)
        + 0.25 * _clip01((c("goldstein_baseline") - c("goldstein_window")) / 4)
        + 0.15 * _clip01(F.when(volume > 0, F.log2(volume) / 2).otherwise(0.0))
    )
    out = out.withColumn("score", score)
    if rounded:
        digits = {"score": 4, "baseline_daily_events": 2, "window_daily_events": 2, "material_z": 2, "material_share_window": 4, "material_share_baseline": 4, "goldstein_window": 3, "goldstein_baseline": 3}
        for name, d in digits.items():
            out = out.withColumn(name, F.bround(name, d))
    return out.orderBy(F.col("score").desc(), key)


#: Bars of a year, over which the range runs.
YEAR = 252


def technicals(bars: DataFrame, keys: Sequence[str], day: str = "day", close: str = "close") -> DataFrame:
    """Indicators at the last bar of each series: returns, distance from moving averages, volatility, drawdown, range.

    Each is null where the series does not cover it; the range is that of the last YEAR bars.
    """
    order = Window.partitionBy(*keys).orderBy(day)
    trail = lambda k: order.rowsBetween(-(k - 1), 0)
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(close)
    rows = bars.where(x.isNotNull()).select(*keys, day, close)
    rows = rows.withColumn("__n", F.row_number().over(order)).withColumn("__last", F.lead(day).over(order).isNull())
    rows = rows.withColumn("__change", F.try_divide(x, F.lag(close).over(order)) - 1).withColumn("__draw", F.try_divide(x, F.max(close).over(up_to)) - 1)
    for k in (21, 63, 126, 252):
        past = F.lag(close, k).over(order)
        rows = rows.withColumn(f"return_{k}", F.when(past != 0, x / past - 1))
    for k in (20, 50, 200):
        rows = rows.withColumn(f"sma_{k}_distance", F.when(F.col("__n") >= k, F.try_divide(x, F.avg(close).over(trail(k))) - 1))
    rows = rows.withColumn("volatility_21", F.when(F.count("__change").over(trail(21)) >= 2, F.stddev_samp("__change").over(trail(21)) * F.sqrt(F.lit(252.0))))
    rows = rows.withColumn("max_drawdown", F.when(F.col("__n") >= 2, F.min("__draw").over(up_to)))
    rows = rows.withColumn("from_high", F.try_divide(x, F.max(close).over(trail(YEAR))) - 1).withColumn("from_low", F.try_divide(x, F.min(close).over(trail(YEAR))) - 1)
    rows = rows.withColumn("return_1y", F.when(F.col("__n") >= 240, F.try_divide(x, F.first(close).over(up_to)) - 1))
    n = F.col("__n")
    rows = rows.withColumn("quality", F.when(n >= 200, "full").when(n >= 60, "partial").otherwise("minimal")).withColumn("bars", n.cast("long"))
    return rows.where("__last").drop("__n", "__last", "__change", "__draw")


def wilder_rsi(bars: DataFrame, keys: Sequence[str], day: str = "day", close: str = "close", period: int = 14) -> DataFrame:
    """RSI at the last bar: exponential means of gains and losses with weight 1 / period from the first change.

    Null with ``period`` bars or fewer and for a flat series; 100 without losses. The mean is a fold over each series in
    order, inside the JVM; a series is as long as its bars.
    """
    listed = bars.where(F.col(close).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("t"), F.col(close).cast("double").alias("x")))).alias("s"))
    a = 1.0 / period
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"), F.lit(0.0).alias("past"))

    def step(acc: Column, bar: Column) -> Column:
        d = bar["x"] - acc["past"]
        gain, loss = F.greatest(d, F.lit(0.0)), F.greatest(-d, F.lit(0.0))
        i = acc["i"] + 1
        mean = lambda old, new: F.when(acc["i"] == 0, 0.0).when(acc["i"] == 1, new).otherwise((1 - a) * old + a * new)
        return F.struct(i.alias("i"), mean(acc["gain"], gain).alias("gain"), mean(acc["loss"], loss).alias("loss"), bar["x"].alias("past"))

    out = listed.select(*keys, F.aggregate("s", start, step).alias("r"))
    gain, loss = F.col("r.gain"), F.col("r.loss")
    rsi = F.when(F.col("r.i") <= period, None).when((gain == 0) & (loss == 0), None).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return out.select(*keys, F.round(rsi, 1).alias("rsi"))


def volume_ratio(bars: DataFrame, keys: Sequence[str], day: str = "day", volume: str = "volume") -> DataFrame:
    """Mean volume of the last 21 bars over that of the last 63; null with fewer than 21."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(day).desc()))
    recent = bars.where(F.col(volume).isNotNull()).withColumn("__r", rank).where("__r <= 63")
    out = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("__r") <= 21, F.col(volume))).alias("short"), F.avg(volume).alias("long"))
    return out.select(*keys, F.when(F.col("n") >= 21, F.try_divide("short", "long")).alias("volume_ratio"))


def equity_curve(trades: DataFrame, keys: Sequence[str], time: str, pnl: str, initial: Column | float = 0.0, tie: str | None = None) -> DataFrame:
    """Running sum of profit and loss on top of the initial cash."""
    order = Window.partitionBy(*keys).orderBy(time, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    first = initial if isinstance(initial, Column) else F.lit(float(initial))
    return trades.withColumn("equity", first + F.sum(pnl).over(order))


def sessions(events: DataFrame, user: str, time: str, gap: str) -> DataFrame:
    """Sessions of each user: events closer than ``gap`` belong together."""
    return events.groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("started"), F.max(time).alias("ended")).drop("w")


def watermarks(df: DataFrame, key: str, time: str) -> DataFrame:
    """Where each key's next read resumes."""
    return df.groupBy(key).agg(F.max(time).alias("latest"))


def slot_means(signals: DataFrame, keys: Sequence[str], start: str, step: str, values: str) -> DataFrame:
    """Daily means of an array of slots that begin at ``start`` (epoch seconds) and last ``step`` seconds; nulls do not
    count and days without values are left out."""
    slots = signals.select(*keys, start, step, F.posexplode(values).alias("i", "x"))
    day = F.to_date(F.timestamp_seconds(F.col(start) + F.col("i") * F.col(step)))
    return slots.where(F.col("x").isNotNull()).groupBy(*keys, day.alias("day")).agg(F.avg("x").alias("mean"))
