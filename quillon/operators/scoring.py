"""Forecast scores, calibration, statement scores, trading results and probability repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COST, SLIPPAGE, ALPHA = 0.001, 0.0005, 0.001
#: Fixed values of the published scores.
ALTMAN_SAFE, ALTMAN_DISTRESS = 2.99, 1.81
FINANCIAL_SECTORS = ["financial services", "financials", "financial"]
FINANCIAL_INDUSTRIES = ["bank", "insurance", "capital markets", "credit"]


def brier(probability: Column, happened: Column) -> Column:
    return F.pow(probability - happened.cast("double"), 2)


def time_adjusted(probability: Column, happened: Column, resolved: Column, horizon: Column, alpha: float = ALPHA) -> Column:
    """0 if it did not happen, else (1 - Brier) less a share for each day between resolution and horizon."""
    days = F.abs(F.datediff(resolved, horizon)).cast("double")
    return F.when(~happened, 0.0).otherwise((1 - brier(probability, happened)) * F.greatest(F.lit(0.0), 1 - alpha * days))


def on_time(happened: Column, resolved: Column, horizon: Column) -> Column:
    return happened & (resolved <= horizon)


def horizon_class(created: Column, horizon: Column) -> Column:
    days = F.datediff(horizon, created)
    return F.when(days <= 30, "short").when(days <= 180, "medium").otherwise("long")


def calibration(predictions: DataFrame, probability: str, outcome: Column, by: Sequence[str] = (), buckets: int = 5) -> DataFrame:
    """Count, mean probability and share that happened by bucket of probability, the last one closed; empty buckets stay."""
    spark = predictions.sparkSession
    index = F.least(F.floor(F.col(probability) * buckets), F.lit(buckets - 1)).cast("int")
    own = predictions.where(outcome.isNotNull()).groupBy(*by, index.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg(outcome.cast("double")).alias("hit_rate"))
    frame = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    if by:
        frame = predictions.select(*by).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return frame.join(own, [*by, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_summary(predictions: DataFrame, probability: Column, happened: Column, resolved: Column, horizon: Column, by: Sequence[str]) -> DataFrame:
    """Resolved predictions by group: how many, mean Brier score, mean time-adjusted score, and the share that happened
    in time. ``happened`` is null where a prediction is still open."""
    own = predictions.where(happened.isNotNull())
    return own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(brier(probability, happened)).alias("mean_brier"),
        F.avg(time_adjusted(probability, happened, resolved, horizon)).alias("mean_time_adjusted"),
        F.avg(F.when(on_time(happened, resolved, horizon), 1.0).otherwise(0.0)).alias("share_in_time"),
    )


def per_share_costs(price: Column) -> Column:
    return price * (COST + SLIPPAGE)


def realised(direction: Column, quantity: Column, opened: Column, closed: Column) -> Column:
    """Profit after cost and slippage of both sides."""
    sign = F.when(F.lower(direction) == "short", -1.0).otherwise(1.0)
    return (closed - opened) * quantity * sign - (per_share_costs(opened) + per_share_costs(closed)) * quantity


def unrealised(direction: Column, quantity: Column, opened: Column, price: Column) -> Column:
    """Profit at the current price without costs; 0 without a price."""
    sign = F.when(F.lower(direction) == "short", -1.0).otherwise(1.0)
    return F.coalesce((price - opened) * quantity * sign, F.lit(0.0))


def benchmark_quantity(cash: Column, price: Column) -> Column:
    return F.try_divide(cash, price + per_share_costs(price))


def portfolio_results(portfolios: DataFrame, trades: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """Closed trades, realised profit, share of winners and return of each portfolio, those without trades included."""
    closed = trades.where(F.col("pnl").isNotNull()).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_closed"), F.sum("pnl").alias("pnl"), F.avg(F.when(F.col("pnl") > 0, 100.0).otherwise(0.0)).alias("win_pct"))
    out = portfolios.join(closed.withColumnRenamed("portfolio_id", "id"), "id", "left")
    return out.withColumn("n_closed", F.coalesce("n_closed", F.lit(0))).withColumn("pnl", F.coalesce("pnl", F.lit(0.0))).withColumn("return_pct", F.col("pnl") / initial * 100)


def statement_items(statements: DataFrame, items: dict[str, Sequence[str]], periods: int = 2) -> DataFrame:
    """One row for each ticker with name_0, name_1, ...: the first label of each item that has a value in the period.

    ``statements``: ticker, item, period_rank, value.
    """
    cols = []
    for name, labels in items.items():
        for p in range(periods):
            parts = [F.max(F.when((F.col("item") == label) & (F.col("period_rank") == p) & ~F.isnan("value"), F.col("value"))) for label in labels]
            cols.append(F.coalesce(*parts).alias(f"{name}_{p}"))
    return statements.groupBy("ticker").agg(*cols)


#: Labels of statement lines, in order of preference.
ITEMS: dict[str, Sequence[str]] = {
    "total_assets": ["Total Assets"],
    "total_liabilities": ["Total Liabilities Net Minority Interest", "Total Liab"],
    "working_capital": ["Working Capital"],
    "current_assets": ["Current Assets", "Total Current Assets"],
    "current_liabilities": ["Current Liabilities", "Total Current Liabilities"],
    "retained": ["Retained Earnings"],
    "ebit": ["EBIT", "Operating Income"],
    "revenue": ["Total Revenue", "Operating Revenue"],
    "net_income": ["Net Income", "Net Income Common Stockholders"],
    "operating_cash": ["Operating Cash Flow", "Total Cash From Operating Activities"],
    "long_debt": ["Long Term Debt", "Long Term Debt And Capital Lease Obligation"],
    "shares": ["Ordinary Shares Number", "Share Issued"],
    "gross_profit": ["Gross Profit"],
}


def financial(sector: Column, industry: Column) -> Column:
    named = F.lower(F.trim(sector)).isin(FINANCIAL_SECTORS)
    return F.coalesce(named, F.lit(False)) | F.coalesce(F.lower(industry).rlike("|".join(FINANCIAL_INDUSTRIES)), F.lit(False))


def altman(market_cap: Column, exempt: Column) -> tuple[Column, Column]:
    """Score and zone over the columns of statement_items: all seven inputs or none; financial companies are exempt."""
    c = F.col
    ta, tl = F.nullif(c("total_assets_0"), F.lit(0.0)), F.nullif(c("total_liabilities_0"), F.lit(0.0))
    wc = F.coalesce(c("working_capital_0"), c("current_assets_0") - c("current_liabilities_0"))
    z = 1.2 * wc / ta + 1.4 * c("retained_0") / ta + 3.3 * c("ebit_0") / ta + 0.6 * market_cap / tl + 1.0 * c("revenue_0") / ta
    zone = F.when(exempt, "not_applicable").when(z.isNull(), "unavailable").when(z > ALTMAN_SAFE, "safe").when(z < ALTMAN_DISTRESS, "distress").otherwise("grey")
    return F.when(~exempt, F.bround(z, 2)), zone


def piotroski() -> tuple[Column, Column]:
    """Score (null if nothing can be tested) and number of the nine tests whose inputs exist."""
    c = F.col
    over = lambda a, b: F.try_divide(c(a), c(b))
    roa = [over(f"net_income_{p}", f"total_assets_{p}") for p in (0, 1)]
    debt = [over(f"long_debt_{p}", f"total_assets_{p}") for p in (0, 1)]
    liquid = [over(f"current_assets_{p}", f"current_liabilities_{p}") for p in (0, 1)]
    margin = [over(f"gross_profit_{p}", f"revenue_{p}") for p in (0, 1)]
    turnover = [over(f"revenue_{p}", f"total_assets_{p}") for p in (0, 1)]
    tests = F.array(
        roa[0] > 0,
        c("operating_cash_0") > 0,
        roa[0] > roa[1],
        c("operating_cash_0") > c("net_income_0"),
        debt[0] <= debt[1],
        liquid[0] > liquid[1],
        c("shares_0") <= c("shares_1"),
        margin[0] > margin[1],
        turnover[0] > turnover[1],
    )
    known = F.filter(tests, lambda t: t.isNotNull())
    n = F.size(known)
    return F.when(n > 0, F.size(F.filter(known, lambda t: t))), n


def data_quality(has_statements: Column, ratios: Column, testable: Column) -> Column:
    return F.when(has_statements & (ratios >= 5) & (testable >= 7), "full").when(has_statements, "partial").when(ratios > 0, "minimal").otherwise("none")


def normalised_probabilities(df: DataFrame, group: str, probability: Column, out: str = "probability") -> DataFrame:
    """Shares within each group: not numeric or negative counts as 0, all zero as uniform; four digits, 0.01 at least."""
    p = F.greatest(F.coalesce(probability.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    p = F.when(F.isnan(p), 0.0).otherwise(p)
    w = Window.partitionBy(group)
    total = F.sum(p).over(w)
    share = F.when(total > 0, p / total).otherwise(1.0 / F.count(F.lit(1)).over(w))
    return df.withColumn(out, F.greatest(F.bround(share, 4), F.lit(0.01)))


def reviewed(scenarios: DataFrame, answers: DataFrame, today: Column, epsilon: float = 0.01) -> DataFrame:
    """New probabilities of open scenarios where they move by more than ``epsilon``; overdue sets are never revised."""
    joined = scenarios.join(answers.select("scenario_id", F.col("probability").alias("__new")), "scenario_id", "left")
    moved = (F.col("status") == "active") & (F.col("horizon_date") >= today) & F.col("__new").isNotNull() & (F.abs(F.col("__new") - F.col("probability")) > epsilon)
    return joined.withColumn("revised", F.coalesce(moved, F.lit(False))).withColumn("probability", F.when(F.col("revised"), F.col("__new")).otherwise(F.col("probability"))).drop("__new")


def resolved(scenarios: DataFrame, winners: DataFrame) -> DataFrame:
    """The winning scenario of each resolved set is true, its siblings are false; other sets stay open."""
    joined = scenarios.join(winners.select("set_id", F.col("scenario_id").alias("__winner")), "set_id", "left")
    return joined.withColumn("outcome", F.when(F.col("__winner").isNotNull(), F.col("scenario_id") == F.col("__winner"))).drop("__winner")


def valid_predictions(df: DataFrame, areas: Sequence[str], kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the rules, and the others with a reason."""
    c = F.col
    reason = (
        F.when(c("probability").isNull() | (c("probability") < 0) | (c("probability") > 1), "probability")
        .when(~F.coalesce(c("macro_area").isin(list(areas)), F.lit(False)), "macro_area")
        .when(~F.coalesce(c("prediction_type").isin(list(kinds)), F.lit(False)), "prediction_type")
        .when(c("horizon_date").isNull(), "horizon_date")
    )
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def prediction_domains(predictions: DataFrame, valid: Sequence[str]) -> DataFrame:
    """prediction_id, domain: the valid domains of predictions (id, domains), each once."""
    rows = predictions.select(F.col("id").alias("prediction_id"), F.explode("domains").alias("domain"))
    return rows.where(F.col("domain").isin(list(valid))).distinct()


def revisions(predictions: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Predictions (id, resolved, probability, ...) with the probability last asked for (id, seq, probability, reason),
    and a log of all changes: id, seq, old_probability, new_probability, reason, revised_at.

    Resolved predictions, and probabilities that are null or not within 0 and 1, are passed over.
    """
    open_ = predictions.where("not resolved").select("id", F.col("probability").alias("__now"))
    new = asked.where("probability >= 0 and probability <= 1").join(open_, "id")
    before = F.lag("probability").over(Window.partitionBy("id").orderBy("seq"))
    log = new.select("id", "seq", F.coalesce(before, "__now").alias("old_probability"), F.col("probability").alias("new_probability"), "reason", now.alias("revised_at"))
    last = new.groupBy("id").agg(F.max_by("probability", "seq").alias("__new"))
    out = predictions.join(last, "id", "left").withColumn("probability", F.coalesce("__new", "probability")).select(predictions.columns)
    return out, log
