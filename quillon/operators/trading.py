"""From a thesis to its trades as whole jobs: approval with its forecast, prices by a chain of sources, opening and linking."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import desk

#: Cash of a portfolio, and the share of it that goes into one trade.
CASH, ALLOCATION = 100_000.0, 0.10


class Approval(NamedTuple):
    theses: DataFrame
    predictions: DataFrame
    report: DataFrame


class Opening(NamedTuple):
    trades: DataFrame
    predictions: DataFrame
    report: DataFrame


def approved(theses: DataFrame, requested: DataFrame, tickers: DataFrame, today: Column) -> Approval:
    """Theses (id, status, instrument, direction, title, confidence, horizon_days) after the requested ones (id) were
    approved, the economic forecast of each that was, and a report: id, outcome, ticker_valid.

    Only pending theses can be approved; the outcome of others is 'not pending', of unknown ids 'not found'. Whether the
    ticker is known is told and stops nothing; it is null without an instrument. Repeated requests count once.
    """
    asked = requested.select("id").where("id is not null").distinct()
    known = tickers.select(F.upper(F.trim("ticker")).alias("__ticker")).where("__ticker is not null").distinct()
    ticker = F.upper(F.trim("instrument"))
    found = asked.join(theses.select("id", "status", "instrument"), "id", "left").join(known, ticker == F.col("__ticker"), "left")
    outcome = F.when(F.col("status").isNull(), "not found").when(F.col("status") == "pending", "approved").otherwise("not pending")
    report = found.select("id", outcome.alias("outcome"), F.when(ticker != "", F.col("__ticker").isNotNull()).alias("ticker_valid"))
    done = report.where("outcome = 'approved'").select("id", F.lit("approved").alias("__new"))
    after = theses.join(done, "id", "left").withColumn("status", F.coalesce("__new", "status")).select(theses.columns)
    return Approval(after, desk.thesis_predictions(theses.join(done, "id", "left_semi"), today), report)


def prices(tickers: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """ticker, price: of each ticker once, the price of the first source (ticker, price) that has one other than zero."""
    out = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()
    found = []
    for k, source in enumerate(sources):
        usable = source.where("price is not null and not isnan(price) and price <> 0").groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.max("price").alias(f"__{k}"))
        out = out.join(usable, "ticker", "left")
        found.append(F.col(f"__{k}"))
    return out.select("ticker", (F.coalesce(*found) if found else F.lit(None).cast("double")).alias("price"))


def opened(theses: DataFrame, requested: DataFrame, trades: DataFrame, predictions: DataFrame, sources: Sequence[DataFrame], pool: Sequence[str], now: Column) -> Opening:
    """The trades that requested theses open, the forecasts with the trade that they are linked to, and a report.

    An approved thesis with an instrument, a price and no open trade of its own opens two trades: its own in portfolio
    'agent', and in 'random' one of a ticker that its id picks from ``pool``, at that ticker's price or else the same one.
    Each takes ALLOCATION of CASH; their ids are twice the thesis's id, and one more. Of the forecasts of the thesis the
    oldest open economic one without a trade takes the agent's. A direction other than 'short' buys.

    The report's outcome is 'opened', 'not found', 'not approved', 'no instrument', 'has an open trade' or 'no price'.
    """
    asked = requested.select("id").where("id is not null").distinct()
    held = trades.where("closed_at is null").select(F.col("thesis_id").alias("__held")).where("__held is not null").distinct()
    own = asked.join(theses.select("id", "status", "instrument", "direction", "title"), "id", "left").join(held, F.col("id") == F.col("__held"), "left")
    own = own.withColumn("ticker", F.upper(F.trim("instrument"))).withColumn("control", desk.random_control(F.col("id"), pool))
    known = prices(own.select("ticker").union(own.select(F.col("control").alias("ticker"))), sources)
    named = lambda c: known.select(F.col("ticker").alias(f"__{c}"), F.col("price").alias(f"{c}_price"))
    priced = own.join(named("ticker"), F.col("ticker") == F.col("__ticker"), "left").join(named("control"), F.upper("control") == F.col("__control"), "left")
    outcome = (
        F.when(F.col("status").isNull(), "not found").when(F.col("status") != "approved", "not approved").when(F.coalesce("ticker", F.lit("")) == "", "no instrument")
        .when(F.col("__held").isNotNull(), "has an open trade").when(F.col("ticker_price").isNull(), "no price").otherwise("opened")
    )
    judged = priced.withColumn("outcome", outcome)
    way = F.when(F.lower("direction") == "short", "sell").otherwise("buy")
    trade = lambda k, portfolio, ticker, price, notes: F.struct((F.col("id") * 2 + k).alias("trade_id"), F.lit(portfolio).alias("portfolio"), ticker.alias("ticker"), price.alias("price_open"), (CASH * ALLOCATION / price).alias("quantity"), notes.alias("notes"))
    both = F.array(
        trade(0, "agent", F.col("ticker"), F.col("ticker_price"), F.concat(F.lit("Agent: "), F.substring(F.coalesce("title", F.lit("")), 1, 60))),
        trade(1, "random", F.col("control"), F.coalesce("control_price", "ticker_price"), F.concat(F.lit("Random control for thesis "), F.col("id").cast("string"))),
    )
    new = judged.where("outcome = 'opened'").select(F.col("id").alias("thesis_id"), way.alias("direction"), F.explode(both).alias("t")).select("t.*", "thesis_id", "direction", now.alias("opened_at"))
    linked = desk.linked_to_trades(predictions, new.where("portfolio = 'agent'").select("trade_id", "thesis_id"))
    return Opening(new, linked, judged.select("id", "outcome"))


def open_trades(trades: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Trades that are not closed, with the name of their portfolio, the newest first."""
    rows = trades.where("closed_at is null").join(portfolios.select(F.col("id").alias("portfolio_id"), F.col("name").alias("portfolio")), "portfolio_id")
    return rows.select("portfolio", "ticker", "direction", "quantity", "price_open", "opened_at").orderBy(F.col("opened_at").desc())


def watched_scenarios(scenarios: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Items of the watchlist beside the scenario (id, set_id, label) that they belong to, by set and label."""
    own = scenarios.select(F.col("id").alias("scenario_id"), "set_id", F.col("label").alias("scenario"))
    return own.join(watchlist, "scenario_id").select("set_id", "scenario", "label", "indicator_query", "status", "triggered_at").orderBy("set_id", "scenario", "label")
