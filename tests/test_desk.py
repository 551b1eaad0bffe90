"""Operators on what analysts keep: alerts, states, theses, checks and briefs, against small tables by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import lookups, scalar
from quillon.operators import alerts, brief, desk, entities, grouping, health, scoring, vectors
from quillon.sources import feeds, sinks
from quillon.streaming import streams


def series(spark, last, **more):
    rows = [(f"2024-01-{d:02d}", float(10 + d % 2), *more.values()) for d in range(1, 31)] + [("2024-01-31", last, *more.values())]
    return spark.createDataFrame(rows, ["date", "x", *more])


def test_points_become_events_once(spark):
    s = series(spark, 90.0, portid="p1", portname="Suez").withColumn("n_total", F.col("x").cast("int")).drop("x")
    e = alerts.transit_events(s).collect()
    assert [(r.title, r.event_type, r.origin, r.severity, r.location_name) for r in e] == [("Suez transit anomaly 2024-01-31", "infrastructure", "portwatch", 5, "Suez")]
    assert e[0].summary == "Suez: 90 vessel transits on 2024-01-31, +757% vs 30d baseline (10±1, z=+156.3) — transit surge."
    there = spark.createDataFrame([("Suez transit anomaly 2024-01-31",)], "title string")
    assert alerts.transit_events(s, there).count() == 0


@pytest.mark.parametrize(("last", "fires", "outages"), [(90.0, 1, 0), (0.0, 0, 1), (40.0, 0, 0)])
def test_alerts_look_one_way(spark, last, fires, outages):
    s = series(spark, last, area="A", country_code="SY", country_name="Syria", frp_max=3.5, lat=1.0, lon=2.0)
    f = alerts.fire_events(s.withColumnRenamed("x", "n_detections")).collect()
    o = alerts.outage_events(s.withColumnRenamed("x", "signal_bgp")).collect()
    assert (len(f), len(o)) == (fires, outages)
    assert all(r.title == "A fire anomaly 2024-01-31" and r.lat == 1.0 and "peak FRP" in r.summary for r in f)
    assert all(r.title == "Internet disruption — Syria (2024-01-31)" and r.location_name is None and 1 <= r.severity <= 5 for r in o)


def test_moods_below_zero_count(spark):
    rows = [("UP", 4, f"2024-01-{d:02d}", -1.0 - d % 2, 5, 0.0) for d in range(1, 31)] + [("UP", 4, "2024-01-31", -9.0, 5, -2.0)]
    s = spark.createDataFrame(rows, "country string, quad_class int, day string, goldstein double, n long, avg_tone double")
    e = alerts.mood_events(s).collect()
    assert [r.title for r in e] == ["UP material conflict anomaly 2024-01-31"] and "— escalation. Avg tone -2.0." in e[0].summary and "(5 events)" in e[0].summary


def test_names_of_places_and_bodies(spark):
    kind, name = lookups.classified(F.col("n"), F.lit("company"))
    df = spark.createDataFrame([("Russian",), ("UK",), ("NATO",), ("Acme",)], "n string")
    assert [tuple(r) for r in df.select(kind, name).collect()] == [("location", "Russia"), ("location", "United Kingdom"), ("organization", "NATO"), ("company", None)]
    df = spark.createDataFrame([("UP", 4), ("XX", 9)], "c string, q int")
    got = df.select(lookups.country_name(F.col("c")), lookups.country_iso2(F.col("c")), lookups.quad_label(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [("Ukraine", "UA", "material conflict"), ("XX", None, "quad9")]


def test_places_in_other_words(spark):
    e = spark.createDataFrame([(1, "Russia", 9), (2, "Russian", 4), (3, "Lima", 3), (4, "UK", 2), (5, "England", 2), (6, "Moskva", 1)], "id long, name string, mentions long")
    keys = spark.createDataFrame([("moskva", "Russia")], "name string, label string")
    got = {r.id: (r.canonical_id, r.label) for r in entities.canonical_places(e, keys).collect()}
    assert got == {1: (1, "Russia"), 2: (1, "Russia"), 6: (1, "Russia"), 4: (4, "United Kingdom"), 5: (4, "United Kingdom")}


def test_ids_of_the_knowledge_base(spark):
    e = spark.createDataFrame([(1, "FRANCE", "company", 9), (2, "France", "location", 5), (3, "Turkey", "location", 5), (4, "Chad", "person", 1)], "id long, name string, entity_type string, mentions long").withColumn("canonical_entity_id", F.lit(None).cast("long"))
    found = spark.createDataFrame([("FRANCE", "company", "Q142", "location"), ("France", "location", "Q142", "location"), ("Turkey", "location", "Q43", "location"), ("Chad", "person", "Q657", "location")], "name string, entity_type string, qid string, found_type string")
    got = {r.id: (r.wikidata_qid, r.canonical_entity_id) for r in entities.linked_qids(e, found).collect()}
    assert got == {1: (None, 2), 2: ("Q142", None), 3: ("Q43", None), 4: (None, None)}


def test_edges_follow_merged_rows(spark):
    edges = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.5), (2, 3, 0.7), (3, 4, 0.2)], "entity_a long, entity_b long, strength double")
    moved = spark.createDataFrame([(1, 1), (2, 1)], "id long, kept long")
    assert sorted(map(tuple, entities.repointed(edges, moved).collect())) == [(1, 3, 0.7), (3, 4, 0.2)]


def test_states_change_in_order(spark):
    items = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "rejected"), (4, "pending")], "id long, status string")
    asked = spark.createDataFrame([(1, 1, "approved"), (1, 2, "rejected"), (2, 5, "open"), (3, 1, "approved"), (2, 6, "rejected")], "id long, seq long, status string")
    assert {r.id: r.status for r in desk.changed(items, asked, desk.CHANGES["thesis"]).collect()} == {1: "approved", 2: "rejected", 3: "rejected", 4: "pending"}
    steps = {"a": ["b"], "b": ["c"]}
    items = spark.createDataFrame([(1, "a"), (2, "a")], "id long, status string")
    asked = spark.createDataFrame([(1, 1, "c"), (1, 2, "b"), (1, 3, "c"), (2, 1, "c")], "id long, seq long, status string")
    assert {r.id: r.status for r in desk.changed(items, asked, steps).collect()} == {1: "c", 2: "a"}
    with pytest.raises(ValueError, match="lead back"):
        desk.changed(items, asked, {"a": ["b"], "b": ["a"]})


def test_answers_become_theses(spark):
    one = {"title": "T", "instrument": "XLE", "direction": "long", "horizon_days": 20, "confidence": 0.7, "indicators": [{"label": " oil ", "indicator_query": "q"}, {"label": ""}], "alternatives": [{"title": "A", "confidence": "high"}]}
    rows = [(1, json.dumps([one, {"title": "U"}, {"title": "V"}, {"title": "W"}])), (2, "no list"), (3, None), (4, "[]")]
    df = spark.createDataFrame(rows, "answer_id long, text string")
    got = desk.proposals(df, 3).orderBy("place", "alternative").collect()
    assert [(r.answer_id, r.place, r.alternative, r.title, r.confidence, r.status) for r in got] == [(1, 0, 0, "T", 0.7, "pending"), (1, 0, 1, "A", None, "pending"), (1, 1, 0, "U", None, "pending"), (1, 2, 0, "V", None, "pending")]
    items = desk.watchlist(desk.proposals(df).where("title = 'T'").withColumn("id", F.lit(7)), "Thesis").collect()
    assert [(r.owner_id, r.label, r.description, r.status) for r in items] == [(7, "oil", "Thesis 7: oil", "active")]
    theses = spark.createDataFrame([(1, "T", "XLE", "long", 20, 1.7), (2, "U", None, None, None, None)], "id long, title string, instrument string, direction string, horizon_days int, confidence double")
    p = desk.thesis_predictions(theses, F.lit("2024-01-01").cast("date")).collect()
    assert [(r.description, r.probability, r.horizon_date) for r in p] == [("XLE long entro 20gg — T", 1.0, "2024-01-21"), ("strumento n/d entro 30gg — U", 0.5, "2024-01-31")]


def test_trades_take_the_oldest_open_prediction(spark):
    p = spark.createDataFrame([(1, 5, "economic", None, True), (2, 5, "economic", None, False), (3, 5, "economic", None, False), (4, 6, "military", None, False)], "id long, thesis_id long, macro_area string, trade_id long, resolved boolean")
    t = spark.createDataFrame([(10, 5), (11, 6)], "trade_id long, thesis_id long")
    assert {r.id: r.trade_id for r in desk.linked_to_trades(p, t).collect()} == {1: None, 2: 10, 3: None, 4: None}


def test_random_control_is_seeded_by_id(spark):
    pool = ["A", "B", "C", "D", "E"]
    got = spark.range(40).select("id", desk.random_control(F.col("id"), pool).alias("t")).collect()
    assert all(r.t == random.Random(r.id).choice(pool) for r in got)


def test_probabilities_on_bounds(spark):
    rows = [(p, True, False, True, 0.1, None, "military", "x") for p in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)] + [(0.5, False, None, None, None, None, "military", "x")]
    df = spark.createDataFrame(rows, "probability double, resolved boolean, outcome boolean, outcome_eventual boolean, brier_score double, time_adjusted_score double, macro_area string, prediction_type string")
    got = {(r.section, r.label): (r.n, r.accuracy) for r in desk.calibration_report(df, ["military"], []).collect()}
    assert got == {("overall", "all"): (6, None), ("area", "military"): (6, None)} | {("bucket", b): (2 if b == "80-100%" else 1, 1.0) for b in desk.BUCKETS}


def test_revisions_are_logged(spark):
    p = spark.createDataFrame([(1, False, 0.5), (2, True, 0.5)], "id long, resolved boolean, probability double")
    asked = spark.createDataFrame([(1, 1, 0.6, "a"), (1, 2, 0.9, "b"), (1, 3, 1.5, "c"), (2, 1, 0.1, "d")], "id long, seq long, probability double, reason string")
    out, log = scoring.revisions(p, asked, F.lit("now"))
    assert {r.id: r.probability for r in out.collect()} == {1: 0.9, 2: 0.5}
    assert sorted((r.seq, r.old_probability, r.new_probability) for r in log.collect()) == [(1, 0.5, 0.6), (2, 0.6, 0.9)]


def test_checks(spark):
    t = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string")
    out = health.checks(spark, F.lit("2024-01-02 00:00:00"), [health.Fresh("a", t, "t", 24), health.Fresh("b", t, "t", 23, "fetch"), health.Fresh("c", t.limit(0), "t", 1), health.Fresh("d", None, "t", 1), health.Fresh("e", t, "t", 1, enabled=False), health.Fresh("f", t.select(F.lit("x").alias("t")), "t", 1)], [health.Backlog("g", None, F.lit(True), 1)])
    assert {r.name: r.status for r in out.collect()} == {"a": "ok", "b": "warn", "c": "warn", "d": "skip", "e": "skip", "f": "warn", "g": "skip"}
    assert {r.name: r.detail for r in out.collect()}["b"] == "last data 24h — `fetch`"


def test_text_of_a_brief(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, t string")
    parts = [brief.section(df, "Both:", F.concat(F.lit("- "), "t"), ["k"]), brief.section(df.limit(0), "None:", F.col("t"), ["k"]), brief.section(df.limit(0), "None:", F.col("t"), ["k"], empty="Nothing.")]
    assert brief.document(parts).first().text == "Both:\n- a\n- b\n\nNothing."


def test_text_of_technicals(spark):
    cols = "as_of last_close bars return_1w return_1m return_3m return_6m return_1y volatility rsi vs_sma_20 vs_sma_50 vs_sma_200 from_high above_low drawdown volume_ratio".split()
    df = spark.createDataFrame([("X", "2024-01-01", 10.0, 90, 0.015, *[None] * 4, 0.2, 55.4, 0.1, None, None, -0.05, 0.3, -0.1, 1.25, "partial")], "ticker string, " + ", ".join(f"{c} {'string' if c == 'as_of' else 'int' if c == 'bars' else 'double'}" for c in cols) + ", data_quality string")
    assert df.select(brief.technicals_text()).first()[0].split("\n") == [
        "TECHNICALS — X (as of 2024-01-01, last close 10.00)", "Momentum: 1w +1.5%, 1m n/d, 3m n/d, 6m n/d, 1y n/d",
        "Volatility: 21d annualized +20.0%; RSI(14) 55 (70/30 = conventional overbought/oversold bands)", "Trend: price vs SMA20 +10.0%, SMA50 n/d, SMA200 n/d",
        "Range: -5.0% from 90-bar window high, +30.0% above 90-bar window low; max drawdown (window) -10.0%", "Volume: 21d avg = 1.25x the 63d avg", "Data quality: partial (90 daily bars, source: yfinance EOD)"]


def test_vectors_as_bytes_and_points(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [3.0, 6.0, 0.0]), (4, None)], "id long, v array<float>")
    again = df.select("v", vectors.unpacked_floats(vectors.packed_floats(F.col("v"))).alias("w")).collect()
    assert all(r.v == r.w for r in again)
    p = sorted((r.id, r.pc1) for r in vectors.plane(df, "id", "v").collect())
    assert len(p) == 3 and abs((p[1][1] - p[0][1]) - (p[2][1] - p[1][1])) < 1e-9


def test_nearest_edges_and_sweep(spark):
    df = spark.createDataFrame([(i, [float(i // 5), float(i % 5) / 100]) for i in range(10)], "id long, v array<float>")
    edges = grouping.nearest_edges(df, 0.5, k=4)
    assert edges.count() == 20
    got = {r.cap: (r.n_clusters, r.largest, r.n_alone) for r in grouping.cap_sweep(df.withColumn("ord", F.col("id")), edges, 0.5, 0.5, [2, 5]).collect()}
    assert got[5] == (2, 5, 0) and got[2][1] == 2


def test_dates_of_exports(spark):
    df = spark.createDataFrame([("20240102030405", "19240102"), ("", "20240105"), (None, "2024"), ("x", None)], "a string, s string")
    assert [r[0] for r in df.select(scalar.observed_at(F.col("a"), F.col("s"))).collect()] == ["2024-01-02T00:00:00", "2024-01-05T00:00:00", "2024", None]


def test_months_that_are_published(spark):
    assert [r.period for r in feeds.recent_periods(spark, "2024-02-29").collect()] == ["202312", "202311", "202310"]


def test_text_of_conflicts(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,type_of_violence,conflict_name,side_a,side_b,where_description,adm_1,latitude,longitude,country,region,date_start,date_end,deaths_civilians,best\n1,1,C,A,,,Adm,1,2,L,R,2020-01-01 00:00,2020-01-03,,300\n")
    r = feeds.conflicts(spark, str(tmp_path / "u.csv")).first()
    assert r.location_name == "Adm, L" and r.summary == "State-based conflict: A vs ?, Adm, L (R), 2020-01-01 to 2020-01-03. 300 deaths (best estimate, 0 civilians). UCDP GED id 1."


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.replace_table(bad, path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_phases_go_on_where_they_stopped(tmp_path):
    state, calls, broken = str(tmp_path / "s.json"), [], [True]

    def b():
        calls.append("b")
        if broken[0]:
            raise OSError("down")

    phases = [("a", lambda: calls.append("a")), ("b", b)]
    with pytest.raises(OSError, match="down"):
        streams.run_phases(phases, retries=2, state=state)
    assert calls == ["a", "b", "b"] and json.loads(open(state).read()) == {"done": ["a"], "error": "b: down"}
    broken[0] = False
    assert streams.run_phases(phases, state=state) == ["a", "b"] and calls[3:] == ["b"] and not (tmp_path / "s.json").exists()
