"""Approval and opening of trades, with what may be missing."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import trading

THESES = "id long, status string, instrument string, direction string, title string, confidence double, horizon_days int"
POOL = ["AAA", "BBB", "CCC"]


def theses(spark):
    return spark.createDataFrame([
        (1, "pending", " spy ", "long", "one", 0.7, 10), (2, "approved", "qqq", "SHORT", None, None, None), (3, "approved", " ", "long", "three", 2.0, 5),
        (4, "approved", None, None, "four", 0.1, 5), (5, "approved", "QQQ", "neutral", "x" * 80, 0.1, 5), (6, "approved", "zero", "long", "six", 0.1, 5), (7, "rejected", "SPY", "long", "seven", 0.1, 5),
    ], THESES)


def test_approval(spark):
    asked = spark.createDataFrame([(1,), (1,), (2,), (99,), (None,)], "id long")
    done = trading.approved(theses(spark), asked, spark.createDataFrame([("SPY",), ("spy ",), (None,)], "ticker string"), F.lit("2024-01-01").cast("date"))
    assert sorted((r.id, r.outcome, r.ticker_valid) for r in done.report.collect()) == [(1, "approved", True), (2, "not pending", False), (99, "not found", None)]
    assert {r.id: r.status for r in done.theses.collect()} == {1: "approved", 2: "approved", 3: "approved", 4: "approved", 5: "approved", 6: "approved", 7: "rejected"}
    assert [(r.thesis_id, r.probability, r.horizon_date) for r in done.predictions.collect()] == [(1, 0.7, "2024-01-11")]


def test_opening(spark):
    asked = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 4, 5, 6, 7, 99, None)], "id long")
    trades = spark.createDataFrame([(5, None), (2, "2024"), (None, None)], "thesis_id long, closed_at string")
    forecasts = spark.createDataFrame([(31, 2, "economic", None, False), (30, 2, "economic", None, True), (32, 2, "economic", None, False), (33, 5, "economic", None, False)], "id long, thesis_id long, macro_area string, trade_id long, resolved boolean")
    first = spark.createDataFrame([("qqq", 0.0), ("zero", 0.0), ("AAA", float("nan")), (None, 3.0)], "ticker string, price double")
    second = spark.createDataFrame([("QQQ", 40.0), ("BBB", 8.0)], "ticker string, price double")
    done = trading.opened(theses(spark), asked, trades, forecasts, [first, second], POOL, F.lit("now"))
    assert {r.id: r.outcome for r in done.report.collect()} == {1: "not approved", 2: "opened", 3: "no instrument", 4: "no instrument", 5: "has an open trade", 6: "no price", 7: "not approved", 99: "not found"}
    control = random.Random(2).choice(POOL)
    price = {"BBB": 8.0}.get(control, 40.0)
    got = sorted((r.trade_id, r.portfolio, r.ticker, r.direction, r.price_open, r.quantity, r.notes) for r in done.trades.collect())
    assert got == [(4, "agent", "QQQ", "sell", 40.0, pytest.approx(250.0), "Agent: "), (5, "random", control, "sell", price, pytest.approx(10_000 / price), "Random control for thesis 2")]
    assert {r.id: r.trade_id for r in done.predictions.collect()} == {30: None, 31: 4, 32: None, 33: None}
    none = trading.opened(theses(spark).where("false"), asked.where("false"), trades, forecasts, [], POOL, F.lit("now"))
    assert none.trades.count() == none.report.count() == 0 and none.predictions.count() == 4
