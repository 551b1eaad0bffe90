import datetime as dt
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import entities, grouping, relational, scoring, series, vectors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_wins_keeps_null_keys_and_existing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "i int, k string")
    old = spark.createDataFrame([("b",)], "k string")
    assert rows(relational.first_wins(df, ["k"], ["i"], old).select("i")) == [(1,), (3,), (4,)]


def test_insert_or_ignore_on_two_keys(spark):
    df = spark.createDataFrame([(1, "u", "h"), (2, "u", "x"), (3, "v", "h"), (4, "w", None), (5, "z", None)], "i int, url string, hash string")
    assert rows(relational.insert_or_ignore(df, [["url"], ["hash"]], ["i"]).select("i")) == [(1,), (4,), (5,)]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 20.0)], "k string, t int, x double")
    new = spark.createDataFrame([("b", 2, 21.0), ("c", 2, 30.0)], "k string, t int, x double")
    once = relational.last_wins(old, new, ["k"], "t")
    assert rows(once) == [("a", 1, 10.0), ("b", 2, 21.0), ("c", 2, 30.0)]
    assert rows(relational.last_wins(once, new, ["k"], "t")) == rows(once)
    both = relational.additive_upsert(old, new, ["k"], ["x"])
    assert rows(both.select("k", "x")) == [("a", 10.0), ("b", 41.0), ("c", 30.0)]
    part = relational.column_upsert(old, new, ["k"], ["x"])
    assert rows(part.select("k", "t", "x")) == [("a", 1, 10.0), ("b", 1, 21.0), ("c", None, 30.0)] or {tuple(r) for r in part.select("k", "t", "x").collect()} == {("a", 1, 10.0), ("b", 1, 21.0), ("c", None, 30.0)}


def test_pointers_one_hop_or_all(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, p long")
    assert rows(relational.resolve_pointers(df, "id", "p")) == [(1, 1), (2, 1), (3, 2)]
    assert rows(relational.resolve_pointers(df, "id", "p", transitive=True)) == [(1, 1), (2, 1), (3, 1)]


def test_majority_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("e", "b", 1), ("e", "a", 2), ("e", "a", 3), ("e", "b", 4), ("e", None, 0)], "k string, v string, i int")
    assert rows(relational.majority(df, ["k"], "v", ["i"])) == [("e", "b")]


def anomalies(values, baseline, threshold, least=0.0):
    out, kept = [], [(i, v) for i, v in enumerate(values) if v is not None]
    for n, (i, v) in enumerate(kept):
        past = [x for _, x in kept[max(0, n - baseline) : n]]
        if len(past) < 10 or v < least:
            continue
        sd = statistics.stdev(past)
        if sd and abs((v - statistics.fmean(past)) / sd) >= threshold:
            out.append(i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_anomalies_against_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    values = [None if rng.random() < 0.1 else float(round(rng.normal(40, 3) + 60 * (rng.random() < 0.05), 3)) for _ in range(120)]
    df = spark.createDataFrame([("s", f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", v) for i, v in enumerate(values)], "k string, day string, v double")
    got = {r.day for r in series.trailing_anomalies(df, ["k"], "day", "v", 30, 2.5).collect()}
    assert got == {f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}" for i in anomalies(values, 30, 2.5)}


def test_no_lookahead(spark):
    base = [("s", f"2024-01-{i + 1:02d}", 40.0 + i % 3) for i in range(20)]
    later = [*base, ("s", "2024-01-25", 900.0)]
    before = lambda data: rows(series.trailing_anomalies(spark.createDataFrame(data, "k string, day string, v double"), ["k"], "day", "v", 30, 2.0).where("day < '2024-01-21'"))
    assert before(base) == before(later)


def test_hotspots_against_a_loop(spark):
    as_of = dt.date(2024, 6, 1)
    daily = []
    for i in range(1, 105):
        d = as_of - dt.timedelta(days=i)
        if i % 7 == 3:
            continue
        daily.append(("XX", d, 8, 8 if i <= 14 else 1, -8.0 * 8 if i <= 14 else -2.0 * 8, 8))
    df = spark.createDataFrame(daily, "cc string, day date, n long, n4 long, g_sum double, g_n long")
    got = series.hotspots(df, "cc", F.to_date(F.lit("2024-06-01"))).collect()[0]
    base = [next((r[3] for r in daily if r[1] == as_of - dt.timedelta(days=i)), 0) for i in range(15, 105)]
    win = [next((r[3] for r in daily if r[1] == as_of - dt.timedelta(days=i)), 0) for i in range(1, 15)]
    z = (statistics.fmean(win) - statistics.fmean(base)) / statistics.stdev(base)
    assert got.material_z == pytest.approx(z, abs=0.006)
    assert got.goldstein_window == -8.0 and got.material_share_window == 1.0 and 0 < got.score <= 1


def rsi(xs, n=14):
    d = [b - a for a, b in zip(xs, xs[1:])]
    if len(xs) <= n:
        return None
    g, l = max(d[0], 0), max(-d[0], 0)
    for x in d[1:]:
        g, l = g * (1 - 1 / n) + max(x, 0) / n, l * (1 - 1 / n) + max(-x, 0) / n
    return None if g == l == 0 else 100.0 if l == 0 else round(100 - 100 / (1 + g / l), 1)


def test_rsi(spark):
    rng = np.random.default_rng(3)
    data = {"r": [float(x) for x in 50 + rng.normal(size=60).cumsum()], "flat": [5.0] * 30, "up": [float(i) for i in range(30)], "short": [1.0, 2.0]}
    df = spark.createDataFrame([(k, i, x) for k, xs in data.items() for i, x in enumerate(xs)], "k string, day int, close double")
    got = {r.k: r.rsi for r in series.wilder_rsi(df, ["k"]).collect()}
    assert got["flat"] is None and got["up"] == 100.0 and got["short"] is None
    assert got["r"] == pytest.approx(rsi(data["r"]), abs=0.11)


def test_technicals_cover_only_what_there_is(spark):
    df = spark.createDataFrame([("a", i, float(100 + i)) for i in range(30)], "k string, day int, close double")
    r = series.technicals(df, ["k"]).collect()[0]
    assert r.sma_20_distance is not None and r.sma_50_distance is None and r.return_1y is None and r.max_drawdown == 0.0 and r.quality == "minimal"


def test_severities(spark):
    df = spark.createDataFrame([(0.0,), (-1.9,), (-2.0,), (10.0,), (None,)], "g double")
    assert [r[0] for r in df.select(scalar.severity_goldstein(F.col("g"))).collect()] == [1, 1, 2, 5, 1]
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,), (0.2,), (-9.0,)], "z double").select(scalar.severity_z(F.col("z"))).collect()] == [2, 4, 1, 5]


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>a&amp;lt;b</p><br>c  d", "Grand Ayatollah  President Ali Khamenei", "2024-01-02T03:04:05Z", "Ebola – Congo", "Point(10.5 -3)")], "h string, n string, t string, w string, p string")
    lat, lon = scalar.wkt_point(F.col("p"))
    r = df.select(scalar.strip_tags(F.col("h")), scalar.strip_tags(F.col("h"), spaced=True), scalar.person_key(F.col("n")), scalar.parse_time(F.col("t")).cast("string"), scalar.title_country(F.col("w")), lat, lon).collect()[0]
    assert tuple(r) == ("a&lt;bc d", "a&lt;b c d", "ali khamenei", "2024-01-02 03:04:05", "Congo", -3.0, 10.5)


def test_people(spark):
    data = [(1, "Ali Khamenei", 50), (2, "Ayatollah Ali Khamenei", 10), (3, "Khamenei", 5), (4, "Mojtaba Khamenei", 3), (5, "John Smith", 4), (6, "Anna Smith", 3), (7, "Smith", 9), (8, "Solo", 1)]
    df = spark.createDataFrame(data, "id long, name string, mentions long")
    assert rows(entities.canonical_people(df)) == [(2, 1), (3, 1)]


def test_places(spark):
    df = spark.createDataFrame([(["A"],), (["A", "A"],), ([],), (None,), (["A", "B"],), (["A", "x"],), (["A", "B", "x"],), (["x", "y"],)], "c array<string>")
    decision, place = entities.classified_place(F.col("c"), F.array(F.lit("A"), F.lit("B")))
    got = [tuple(r) for r in df.select(decision, place).collect()]
    assert got == [("located", "A"), ("located", "A"), ("skip_none", None), ("skip_none", None), ("skip_bilateral", None), ("located", "x"), ("ambiguous", None), ("ambiguous", None)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (3, 4), (20, 4)], "a long, b long")
    assert rows(grouping.connected_components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (10, 10), (11, 10), (20, 1)]


def test_greedy_duplicates_follow_canonical_rows_only(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    docs = spark.createDataFrame([(1, t(0)), (2, t(1)), (3, t(2)), (4, t(200)), (5, None)], "id long, published timestamp")
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.05), (1, 3, 0.3), (1, 4, 0.1), (4, 5, 0.2)], "a long, b long, distance double")
    assert {r.id: r.duplicate_of for r in grouping.greedy_duplicates(docs, edges).collect()} == {1: None, 2: 1, 3: 1, 4: None, 5: 4}


def linkage(v, order, edges, threshold, prefilter, most):
    root, members = {i: i for i in v}, {i: [i] for i in v}
    centre = {i: np.array(v[i]) for i in v}
    near = {}
    for (a, b), d in edges.items():
        near.setdefault(a, []).append((d, b))
        near.setdefault(b, []).append((d, a))
    for i in order:
        for _, j in sorted(near.get(i, [])):
            a, b = root[i], root[j]
            if a == b or len(members[a]) + len(members[b]) > most or np.linalg.norm(v[i] - centre[b]) > prefilter:
                continue
            if max(np.linalg.norm(v[x] - v[y]) for x in members[a] for y in members[b]) > threshold:
                continue
            k, g = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
            centre[k] = (centre[k] * len(members[k]) + centre[g] * len(members[g])) / (len(members[k]) + len(members[g]))
            for x in members[g]:
                root[x] = k
            members[k] += members.pop(g)
    return {i: min(members[root[i]]) for i in v}


def test_complete_linkage_against_a_loop(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    x = np.vstack([b + 0.25 * rng.normal(size=(6, 8)) for b in base])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = dict(enumerate(x))
    edges = {(i, j): float(np.linalg.norm(v[i] - v[j])) for i in v for j in v if i < j and np.linalg.norm(v[i] - v[j]) <= 0.8}
    df = spark.createDataFrame([(i, i, [float(t) for t in x]) for i, x in v.items()], "id long, ord long, v array<double>")
    e = spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a long, b long, distance double")
    got = {r.id: r.cluster for r in grouping.complete_linkage(df, e, 0.7, 0.75, 4).collect()}
    assert got == linkage(v, sorted(v), edges, 0.7, 0.75, 4)


def test_stories(spark):
    day = 86400.0
    events = spark.createDataFrame([(1, 0.0, day), (2, 2 * day, 3 * day), (3, 40 * day, 41 * day), (4, day, 2 * day)], "event long, lo double, hi double")
    shared = spark.createDataFrame([(e, "p") for e in (1, 2, 3, 4)], "event long, person string")
    docs = spark.createDataFrame([(1, 11, [1.0, 0.0]), (2, 12, [1.0, 0.0]), (2, 13, [0.95, 0.3122]), (3, 14, [1.0, 0.0]), (4, 15, [0.0, 1.0])], "event long, document long, v array<double>")
    assert rows(grouping.link_stories(events, shared, docs)) == [(1, 2), (2, 2)]


def test_knn_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5))
    x[7] = x[3]
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.knn(df, df, 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    for i in range(50):
        d = np.linalg.norm(x - x[i], axis=1)
        want = sorted((j for j in range(50) if j != i), key=lambda j: (d[j], j))[:3]
        assert got[i] == want
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(df, 1.5).collect()}
    assert pairs == {(i, j) for i in range(50) for j in range(i + 1, 50) if np.linalg.norm(x[i] - x[j]) <= 1.5}


def test_calibration_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(0.0, True), (0.2, False), (1.0, True), (0.5, None)], "p double, y boolean")
    got = {r.bucket: r.n for r in scoring.calibration(df, "p", F.col("y")).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}


def test_probabilities(spark):
    df = spark.createDataFrame([("a", "0.5"), ("a", "x"), ("b", "-1"), ("b", None), ("c", "3"), ("c", "1")], "g string, p string")
    got = rows(scoring.normalised_probabilities(df, "g", F.col("p")).select("g", "probability"))
    assert got == [("a", 0.01), ("a", 1.0), ("b", 0.5), ("b", 0.5), ("c", 0.25), ("c", 0.75)]


def test_statement_scores(spark):
    full = {"Total Assets": (100.0, 90.0), "Total Liab": (40.0, 40.0), "Working Capital": (20.0, 18.0), "Retained Earnings": (30.0, 20.0), "EBIT": (15.0, 10.0), "Total Revenue": (120.0, 100.0), "Net Income": (10.0, 5.0), "Operating Cash Flow": (12.0, 6.0), "Long Term Debt": (10.0, 12.0), "Current Assets": (50.0, 40.0), "Current Liabilities": (30.0, 30.0), "Share Issued": (10.0, 10.0), "Gross Profit": (60.0, 45.0)}
    data = [("A", "x", k, p, v) for k, vs in full.items() for p, v in enumerate(vs)] + [("B", "x", "Total Assets", 0, 5.0)]
    st = scoring.statement_items(spark.createDataFrame(data, "ticker string, statement string, item string, period_rank int, value double"), scoring.ITEMS)
    z, zone = scoring.altman(F.when(F.col("ticker") == "A", 80.0), F.lit(False))
    f, n = scoring.piotroski()
    got = {r[0]: tuple(r)[1:] for r in st.select("ticker", z, zone, f, n).collect()}
    assert got["A"] == (round(1.2 * 0.2 + 1.4 * 0.3 + 3.3 * 0.15 + 0.6 * 2 + 1.2, 2), "safe", 9, 9)
    assert got["B"] == (None, "unavailable", None, 0)


def test_purge_by_origin(spark):
    t = {
        "documents": spark.createDataFrame([(1, "g"), (2, "r"), (3, None)], "id long, origin string"),
        "events": spark.createDataFrame([(10, "g"), (11, "r"), (12, None)], "id long, origin string"),
        "event_documents": spark.createDataFrame([(10, 1), (11, 2), (12, 1)], "event_id long, document_id long"),
        "mentions": spark.createDataFrame([(1, 100), (2, 101)], "document_id long, entity_id long"),
        "entities": spark.createDataFrame([(100,), (101,), (102,)], "id long"),
        "links": spark.createDataFrame([(100, 101), (101, 102)], "entity_a long, entity_b long"),
    }
    kept = relational.purge_origin(t, "g")
    assert rows(kept["documents"].select("id")) == [(2,), (3,)] and rows(kept["events"].select("id")) == [(11,)]
    assert rows(kept["entities"]) == [(101,), (102,)] and rows(kept["links"]) == [(101, 102)]
    assert {r.table_name: r.deleted for r in relational.purge_counts(t, kept).collect()}["mentions"] == 1
