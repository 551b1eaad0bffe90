"""Points far from their trailing baseline, promoted to events with a title that tells them apart.

Every function takes the events that are there already; a title that one of them has is not added again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.lookups import quad_label
from quillon.operators.relational import first_wins
from quillon.operators.series import trailing_anomalies

BASELINE, THRESHOLD, OUTAGE_THRESHOLD = 30, 2.0, 2.5
LEAST_FIRES, LOWEST_MOOD, LEAST_EVENTS = 50.0, -10.0, 3


def severity(z: Column, unit: float = 1.0) -> Column:
    """Deviations from the mean, in units, from 1 to 5; halves go to the even number."""
    return F.least(F.greatest(F.bround(F.abs(z) / unit), F.lit(1)), F.lit(5)).cast("int")


def _against(digits: int, baseline: int) -> Column:
    """What a point is against its baseline; halves are shown as the even number."""
    form = f"%+.0f%% vs {baseline}d baseline (%.{digits}f±%.{digits}f, z=%+.1f)"
    return F.format_string(form, F.bround("pct", 0), F.bround("mean", digits), F.bround("std", digits), F.bround("z", 1))


def promoted(found: DataFrame, title: Column, summary: Column, kind: str, origin: str, level: Column, day: Column, place: Column, existing: DataFrame | None = None, lat: Column | None = None, lon: Column | None = None) -> DataFrame:
    """Events of the points found: one for each title, none whose title exists."""
    none = F.lit(None).cast("double")
    day = day.cast("string")
    rows = found.select(title.alias("title"), summary.alias("summary"), day.alias("first_seen"), day.alias("last_seen"), F.lit(kind).alias("event_type"), F.lit(origin).alias("origin"), level.alias("severity"), place.alias("location_name"), (none if lat is None else lat).alias("lat"), (none if lon is None else lon).alias("lon"))
    rows = first_wins(rows, ["title"], ["summary"])
    return rows if existing is None else rows.join(existing.select("title").where("title is not null").distinct(), "title", "left_anti")


def mood_series(events: DataFrame, least: int = LEAST_EVENTS) -> DataFrame:
    """country, quad_class, day, goldstein, n, avg_tone of the cells with ``least`` events or more."""
    cells = events.where("country is not null and goldstein is not null").groupBy("country", "quad_class", "day")
    return cells.agg(F.avg("goldstein").alias("goldstein"), F.count(F.lit(1)).alias("n"), F.avg("avg_tone").alias("avg_tone")).where(F.col("n") >= least)


def mood_events(series: DataFrame, existing: DataFrame | None = None, baseline: int = BASELINE, threshold: float = THRESHOLD, latest_only: bool = True) -> DataFrame:
    """Escalations (below the baseline) and de-escalations of the mean scale of a country and class of events."""
    found = trailing_anomalies(series.withColumnRenamed("n", "n_events"), ["country", "quad_class"], "day", "goldstein", baseline, threshold, least=LOWEST_MOOD, latest_only=latest_only, carry=["n_events", "avg_tone"])
    who = F.concat_ws(" ", "country", quad_label(F.col("quad_class")))
    way = F.when(F.col("z") < 0, "escalation").otherwise("de-escalation")
    summary = F.concat(who, F.format_string(": Goldstein %.2f on %s (%d events), ", "goldstein", F.col("day").cast("string"), "n_events"), _against(2, baseline), F.lit(" — "), way, F.lit(". Avg tone "), F.format_string("%.1f.", "avg_tone"))
    return promoted(found, F.concat(who, F.lit(" anomaly "), F.col("day").cast("string")), summary, "gdelt_anomaly", "gdelt", severity(F.col("z")), F.col("day"), F.col("country"), existing)


def transit_events(series: DataFrame, existing: DataFrame | None = None, baseline: int = BASELINE, threshold: float = THRESHOLD, latest_only: bool = True) -> DataFrame:
    """Drops and surges of ships (portid, portname, date, n_total) through a place; a place without a name goes by its id."""
    found = trailing_anomalies(series, ["portid"], "date", "n_total", baseline, threshold, latest_only=latest_only, carry=["portname"])
    port, day = F.coalesce(F.nullif(F.col("portname"), F.lit("")), F.col("portid")), F.col("date").cast("string")
    summary = F.concat(port, F.lit(": "), F.col("n_total").cast("string"), F.lit(" vessel transits on "), day, F.lit(", "), _against(0, baseline), F.lit(" — transit "), F.when(F.col("z") < 0, "drop").otherwise("surge"), F.lit("."))
    return promoted(found, F.concat(port, F.lit(" transit anomaly "), day), summary, "infrastructure", "portwatch", severity(F.col("z")), day, port, existing)


def fire_events(series: DataFrame, existing: DataFrame | None = None, baseline: int = BASELINE, threshold: float = THRESHOLD, least: float = LEAST_FIRES, latest_only: bool = True) -> DataFrame:
    """Surges of fires (area, date, n_detections, frp_max, lat, lon), of ``least`` detections or more."""
    found = trailing_anomalies(series, ["area"], "date", "n_detections", baseline, threshold, "surge", least, latest_only, carry=["frp_max", "lat", "lon"])
    day = F.col("date").cast("string")
    summary = F.concat(F.col("area"), F.lit(": "), F.col("n_detections").cast("string"), F.lit(" active-fire detections on "), day, F.lit(", "), _against(0, baseline), F.format_string(", peak FRP %.0f MW — fire surge.", F.coalesce("frp_max", F.lit(0.0))))
    return promoted(found, F.concat("area", F.lit(" fire anomaly "), day), summary, "hazard", "firms", severity(F.col("z")), day, F.col("area"), existing, F.col("lat"), F.col("lon"))


def outage_events(series: DataFrame, existing: DataFrame | None = None, baseline: int = BASELINE, threshold: float = OUTAGE_THRESHOLD, latest_only: bool = True) -> DataFrame:
    """Drops of a country's signal (country_code, country_name, date, signal_bgp); severity counts thresholds."""
    found = trailing_anomalies(series, ["country_code"], "date", "signal_bgp", baseline, threshold, "drop", latest_only=latest_only, carry=["country_name"])
    name, day = F.coalesce("country_name", "country_code"), F.col("date").cast("string")
    summary = F.concat(name, F.format_string(": internet BGP signal %.0f on %s, ", F.col("signal_bgp").cast("double"), day), _against(0, baseline), F.lit(" — connectivity disruption."))
    return promoted(found, F.concat(F.lit("Internet disruption — "), name, F.lit(" ("), day, F.lit(")")), summary, "infrastructure", "ioda", severity(F.col("z"), threshold), day, F.lit(None).cast("string"), existing)
