"""Queries over all rows of their job, also where the catalogue's SQL takes fewer."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from oracle import check

from quillon.operators import entities, grouping, relational, vectors
from quillon.plans import catalog


def supplied(spark, path, orders):
    rows = [(o, s) for o, group in orders.items() for s in group]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")
    return Counter(p for group in orders.values() for p in combinations(sorted(set(group)), 2))


def test_components_of_rare_pairs(spark, tmp_path):
    orders = {1: [1, 2], 2: [2, 3, 3], 3: [9, 8], 4: [7], 5: [8, 6], 6: [1, 2]}
    pairs = supplied(spark, tmp_path, orders)
    component = {i: i for p in pairs for i in p}
    for _ in component:
        for a, b in pairs:
            component[a] = component[b] = min(component[a], component[b])
    got = catalog.connected_components(spark, str(tmp_path)).collect()
    assert {r.node: r.component for r in got} == component == {1: 1, 2: 1, 3: 1, 6: 6, 8: 6, 9: 6}


def test_profit_of_every_line(spark, sf):
    check(spark, catalog.realised_pnl, catalog.ORACLE["realised_pnl"], sf)


def test_subgraph_of_the_nodes_of_highest_degree(spark, tmp_path):
    orders = {i: [i, i + 1] for i in range(1, 60)} | {100: [1, 60], 101: [1, 7], 102: [3, 60], 103: [60, 58]}
    pairs = supplied(spark, tmp_path, orders)
    degree = Counter(i for p in pairs for i in p)
    top = sorted(degree, key=lambda i: (-degree[i], i))[:50]
    want = sorted((a, b, n) for (a, b), n in pairs.items() if a in top and b in top)
    got = catalog.induced_subgraph(spark, str(tmp_path)).select("a", "b", "n").collect()
    assert sorted(map(tuple, got)) == want and len(want) < len(pairs)


def test_keywords_of_the_whole_text(spark, tmp_path):
    text = "one two three four five six seven eight nineteen twenty thirty forty fifty sixty seventy eighty"
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "nineteen twenty thirty forty fifty sixty seventy eighty"), (2, "one two three four"), (3, text.upper())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.keyword_trigger(spark, str(tmp_path)).collect()
    assert sorted((r.indicator_id, r.event_id, r.n_hits) for r in got) == [(1, 1, 11), (1, 3, 16)]  # six, seven and eight stand in sixty, seventy and eighty


@pytest.mark.parametrize("block", [4096, 64])
def test_neighbours_among_many_copies(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[rng.permutation(300)[:120]] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r.id, r["rank"]): r.neighbour for r in vectors.knn(df, df, 5).collect()}
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2))
    want = {(i, k + 1): j for i in range(300) for k, j in enumerate([j for j in np.lexsort((np.arange(300), d[i])).tolist() if j != i][:5])}
    assert got == want


def test_rows_that_a_store_with_two_keys_takes(spark):
    rows = [(1, "u", "h"), (2, "v", "h"), (3, "v", "y"), (4, None, "y"), (5, None, None), (6, "u", None), (7, "w", "z")]
    df = spark.createDataFrame(rows, "id long, url string, hash string")
    taken, urls, hashes = [], set(), {"z"}
    for i, u, h in rows:
        if u not in urls and h not in hashes:
            taken.append(i)
            urls |= {u} - {None}
            hashes |= {h} - {None}
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    old = spark.createDataFrame([(0, "q", "z")], "id long, url string, hash string")
    got = relational.insert_or_ignore(df, [["url"], ["hash"]], ["id"], old)
    assert sorted(r.id for r in got.collect()) == taken == [1, 3, 5]


def test_components_of_texts(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r.node: r.component for r in grouping.connected_components(df).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_items_fire_once(spark):
    items = spark.createDataFrame([(1, "active", None), (2, "triggered", "then"), (3, "active", None)], "id long, status string, triggered_at string")
    matches = spark.createDataFrame([(1, 9), (1, 8), (2, 9)], "indicator_id long, event_id long")
    from pyspark.sql import functions as F

    assert sorted(map(tuple, entities.fired(items, matches, F.lit("now")).select("id", "status", "triggered_at").collect())) == [(1, "triggered", "now"), (2, "triggered", "then"), (3, "active", None)]
