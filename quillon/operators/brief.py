"""What a daily brief is written from: five short lists, the events that they name, and the text of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.relational import union_degree

DIVERGENCE, MOST_DIVERGENCES, MOST_HUBS, MOST_ANOMALIES, MOST_RECENT = 0.5, 8, 10, 12, 12
#: Origins of events that sensors report.
SENSORS = ["portwatch", "usgs", "firms", "ioda"]


@dataclass(frozen=True)
class Context:
    divergences: DataFrame
    hubs: DataFrame
    recent: DataFrame
    anomalies: DataFrame
    scenarios: DataFrame

    def n_events(self) -> DataFrame:
        """One row: how many different events the lists name."""
        named = self.divergences.select("event_id").unionByName(self.recent.select("event_id")).unionByName(self.anomalies.select("event_id"))
        return named.agg(F.count_distinct("event_id").alias("n_events"))


def context(events: DataFrame, event_documents: DataFrame, divergences: DataFrame, entities: DataFrame, links: DataFrame, sets: DataFrame, scenarios: DataFrame, since: Column, origin: str = "rss") -> Context:
    """The lists, each cut at the length that a brief has room for; ties go to the smallest id.

    events: id, title, event_type, origin, severity, location_name, last_seen, summary; event_documents: event_id,
    document_id; divergences: event_id, block_a, block_b, divergence_score; entities: id, name; links: entity_a,
    entity_b; sets: id, country_name, horizon_date, status; scenarios: set_id, label, title, probability.
    """
    shown = events.where(F.col("last_seen") >= since).withColumnRenamed("id", "event_id")
    apart = divergences.where(F.col("divergence_score") > DIVERGENCE).join(shown.drop("summary"), "event_id")
    apart = apart.orderBy(F.col("divergence_score").desc(), F.col("last_seen").desc(), "event_id", "block_a", "block_b").limit(MOST_DIVERGENCES)
    hubs = union_degree(links, "entity_a", "entity_b").withColumnRenamed("node", "id").join(entities, "id")
    hubs = hubs.orderBy(F.col("degree").desc(), "id").limit(MOST_HUBS)
    covered = event_documents.where("document_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("doc_count"))
    recent = shown.where(F.col("origin") == origin).join(covered, "event_id").orderBy(F.col("doc_count").desc(), F.col("last_seen").desc(), "event_id").limit(MOST_RECENT)
    anomalies = shown.where(F.col("origin").isin(SENSORS)).orderBy(F.col("severity").desc(), F.col("last_seen").desc(), "event_id").limit(MOST_ANOMALIES)
    active = sets.where("status = 'active'").select(F.col("id").alias("set_id"), "country_name", "horizon_date")
    return Context(apart, hubs, recent, anomalies, active.join(scenarios.select("set_id", "label", "title", "probability"), "set_id", "left").orderBy(F.col("set_id").desc(), "label"))


def section(rows: DataFrame, heading: str, line: Column, order: list[str | Column], empty: str | None = None) -> DataFrame:
    """One row with the text of a short list: heading and a line for each row, in order. Without rows the text is
    ``empty``, or null, which leaves the section out."""
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("k"), line.alias("line"))  # a list of a brief's length
    held = F.array_sort(F.collect_list(F.struct("k", "line")))
    text = F.concat(F.lit(heading + "\n"), F.array_join(F.transform(held, lambda x: x["line"]), "\n"))
    return numbered.agg(F.count(F.lit(1)).alias("n"), text.alias("text")).select(F.when(F.col("n") > 0, F.col("text")).otherwise(F.lit(empty)).alias("text"))


def document(sections: list[DataFrame]) -> DataFrame:
    """One row with the sections that there are, in order."""
    rows = [s.select(F.lit(i).alias("k"), "text") for i, s in enumerate(sections)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    held = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("k", "text"))))
    return out.agg(F.array_join(F.transform(held, lambda x: x["text"]), "\n\n").alias("text"))


def figure(x: Column, form: str = "%.2f") -> Column:
    """A number in its format; n/d where there is none."""
    return F.when(x.isNull(), "n/d").otherwise(F.format_string(form, x))


def share(x: Column) -> Column:
    """A share as a signed percentage with one decimal."""
    return figure(x * 100, "%+.1f%%")


#: Bars from which on a range covers a year.
YEAR = 252


def technicals_text() -> Column:
    """The figures of a ticker in a few lines: where the price stands, and nothing of what to do about it.

    Columns: ticker, as_of, last_close, bars, return_1w to return_1y, volatility, rsi, vs_sma_20, vs_sma_50, vs_sma_200,
    from_high, above_low, drawdown, volume_ratio, data_quality.
    """
    c = F.col
    head = F.concat(F.lit("TECHNICALS — "), c("ticker"), F.when(c("as_of").isNotNull(), F.concat(F.lit(" (as of "), c("as_of").cast("string"), F.lit(", last close "), figure(c("last_close")), F.lit(")"))).otherwise(""))
    listed = lambda pairs: F.concat_ws(", ", *(F.concat(F.lit(f"{n} "), share(c(x))) for n, x in pairs))
    moves = listed([(n, f"return_{n}") for n in ("1w", "1m", "3m", "6m", "1y")])
    rsi = F.when(c("rsi").isNotNull(), F.format_string("; RSI(14) %.0f (70/30 = conventional overbought/oversold bands)", "rsi")).otherwise("")
    span = F.when(c("bars") >= YEAR, "52w").otherwise(F.concat(c("bars").cast("string"), F.lit("-bar window")))
    extent = F.concat(share(c("from_high")), F.lit(" from "), span, F.lit(" high, "), share(c("above_low")), F.lit(" above "), span, F.lit(" low; max drawdown (window) "), share(c("drawdown")))
    volume = F.when(c("volume_ratio").isNull(), "n/d").otherwise(F.format_string("21d avg = %.2fx the 63d avg", "volume_ratio"))
    return F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("Momentum: "), moves),
        F.concat(F.lit("Volatility: 21d annualized "), share(c("volatility")), rsi),
        F.concat(F.lit("Trend: price vs "), listed([(f"SMA{n}", f"vs_sma_{n}") for n in (20, 50, 200)])),
        F.concat(F.lit("Range: "), extent),
        F.concat(F.lit("Volume: "), volume),
        F.concat(F.lit("Data quality: "), c("data_quality"), F.lit(" ("), c("bars").cast("string"), F.lit(" daily bars, source: yfinance EOD)")),
    )
