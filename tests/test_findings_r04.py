"""Findings of round 4: each operator again in many small pieces, or as the plan that made it fail."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_groupings import stories
from test_operators import linkage, rows

from quillon.operators import grouping, vectors


@pytest.mark.parametrize(("threshold", "prefilter"), [(0.7, 0.75), (0.7, 0.5)])
def test_linkage_takes_few_tables(spark, monkeypatch, threshold, prefilter):
    """a chain of attempts is taken in one go, whatever its length, and stretches follow each other."""
    names = []
    real = grouping.written
    monkeypatch.setattr(grouping, "TAKEN", 2000)
    monkeypatch.setattr(grouping, "written", lambda df, name: (names.append(name), real(df, name))[1])
    rng = np.random.default_rng(8)
    x = np.vstack([b + 0.25 * rng.normal(size=(30, 8)) for b in rng.normal(size=(6, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v, order = dict(enumerate(x)), {i: int(o) for i, o in enumerate(rng.permutation(len(x)))}
    edges = {(i, j): float(np.linalg.norm(v[i] - v[j])) for i in v for j in v if i < j and np.linalg.norm(v[i] - v[j]) <= 0.8}
    df = spark.createDataFrame([(i, order[i], [float(t) for t in x]) for i, x in v.items()] + [(999, None, None)], "id long, ord long, v array<double>")
    e = spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a long, b long, distance double")
    got = {r.id: r.cluster for r in grouping.complete_linkage(df, e, threshold, prefilter, 9).collect()}
    assert got == linkage(v, sorted(v, key=order.get), edges, threshold, prefilter, 9) | {999: 999}
    assert 1 < names.count("turn") <= 6


def test_queries_go_once_to_a_piece_of_many_cells(spark, monkeypatch):
    """what is written of a query that asks nearly all cells does not grow with the cells; copies fill pieces of their own."""
    tables = {}
    real = vectors.written
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "written", lambda df, name: tables.setdefault(name, []).append(real(df, name)) or tables[name][-1])
    x = np.vstack([np.random.default_rng(3).normal(size=(600, 24)), np.ones((200, 24))])
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, share = vectors.knn_by_cells(df, vectors.cell_index(df, cells=100), 4)
    want = vectors.knn(df, df, 4)
    assert rows(found.select("id", "rank", "neighbour")) == rows(want.select("id", "rank", "neighbour")) and share > 0.4
    assert [t.count() for t in tables["asked"]] == [800, 800]
    assert max(r["count"] for r in tables["pieces"][0].groupBy("piece").count().collect()) < 100
    # Only what is as near as the bound leaves a task in the second turn.
    pairs = tables["asked"][1].select(F.sum(F.size("cells"))).first()[0]
    assert tables["found"][1].count() < 4 * pairs / 2


def test_stories_list_a_few_attempts_of_each_event(spark, monkeypatch):
    """pairs that are alike are not listed; lists that end are made again, over blocks, persons and stretches."""
    tables = {}
    real = grouping.written
    monkeypatch.setattr(grouping, "written", lambda df, name: tables.setdefault(name, []).append(real(df, name)) or tables[name][-1])
    for name, value in (("LISTED", 3), ("MET", 40), ("TAKEN", 200), ("COMPARED_AT_ONCE", 5000)):
        monkeypatch.setattr(grouping, name, value)
    monkeypatch.setattr(grouping, "discard", lambda *frames: None)
    rng, day = np.random.default_rng(2), 86400.0
    events = [(e, e % 8 * day, e % 8 * day + day) for e in range(100)]
    shared = [(e, f"p{p}") for e in range(100) for p in {e % 2, e % 3 // 2}] + [(0, None), (5, None)]
    docs = []
    for e in range(100):
        for d in range(1 + e % 7 // 6):
            v = rng.normal(size=6)
            docs.append((e, 10 * e + d, None if e % 41 == 0 else [float(x) for x in v / np.linalg.norm(v)]))
    docs += [(100 + k, 9000 + k, docs[3][2]) for k in range(10)]
    events += [(100 + k, 3 * day, 4 * day) for k in range(10)]
    shared += [(100 + k, "p0") for k in range(10)]
    got = grouping.link_stories(spark.createDataFrame(events, "event long, lo double, hi double"), spark.createDataFrame(shared, "event long, person string"), spark.createDataFrame(docs, "event long, document long, v array<double>"), 4.0, 0.1)
    want = stories(events, [s for s in shared if s[1]], docs, 4 * day, 0.1)
    assert rows(got) == want and len(want) > 50
    assert len(tables["openings"]) > 2 and max(t.count() for t in tables["openings"]) <= 120 * 3 * 4
