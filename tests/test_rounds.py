"""Samples, quantiles, indexed neighbours, pointers, and tables that batches are merged into."""

import datetime as dt
import hashlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_operators import rows

from quillon.operators import relational, series, vectors
from quillon.streaming import streams


@pytest.mark.parametrize("parts", [1, 7])
def test_seeded_sample_is_the_same_at_any_partitioning(spark, parts):
    data = [(i, "abc"[i % 3] if i % 10 else None) for i in range(500)] + [(None, "a")]
    got = relational.seeded_sample(spark.createDataFrame(data, "id long, s string").repartition(parts), ["s"], "id", 4, 9)
    by = defaultdict(list)
    for i, s in data:
        if i is not None:
            by[s].append((hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
    assert sorted(r.id for r in got.collect()) == sorted(i for own in by.values() for _, i in sorted(own)[:4])
    assert relational.seeded_sample(got, [], "id", 3, "x").count() == 3


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    data = [("a", float(x)) for x in rng.normal(size=501)] + [("b", 5.0)] * 300 + [("b", float(i)) for i in range(20)] + [("one", 3.0), ("a", None), ("none", None), (None, 1.0), (None, 2.0)]
    got = {r.g: (r.n, r.quantiles) for r in relational.exact_quantiles(spark.createDataFrame(data, "g string, x double").repartition(5), "g", "x", [0.0, 0.1, 0.5, 0.75, 1.0]).collect()}
    assert set(got) == {"a", "b", "one", None}
    for g, (n, q) in got.items():
        own = [x for k, x in data if k == g and x is not None]
        assert n == len(own) and q == pytest.approx(np.quantile(own, [0.0, 0.1, 0.5, 0.75, 1.0]).tolist())


@pytest.mark.parametrize("k", [1, 6])
def test_neighbours_by_cells_are_exact(spark, monkeypatch, k):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    base = 4 * rng.normal(size=(12, 6))
    x = np.vstack([b + 0.4 * rng.normal(size=(50, 6)) for b in base] + [np.repeat(base[:1], 30, 0)])
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)] + [(9999, None)], "vec_id long, embedding array<double>")
    found, share = vectors.knn_by_cells(df, vectors.cell_index(df), k)
    want = vectors.knn(df, df, k)
    assert rows(found.select("id", "rank", "neighbour")) == rows(want.select("id", "rank", "neighbour")) and share < 0.4
    few = df.limit(4)
    found, share = vectors.knn_by_cells(few, vectors.cell_index(few), 9)
    assert found.count() == 12
    none = df.where("false")
    assert vectors.knn_by_cells(df, vectors.cell_index(none), 3)[0].count() == vectors.knn_by_cells(none, vectors.cell_index(df), 3)[0].count() == 0


def test_pointers_are_followed_to_the_end(spark):
    chain = [(i, i - 1) for i in range(1, 80)] + [(0, None), (100, 101), (101, 102), (102, 100), (103, 100), (200, 999)]
    got = {r.id: r.canonical for r in relational.resolve_pointers(spark.createDataFrame(chain, "id long, p long"), "id", "p", transitive=True).collect()}
    assert got == {**{i: 0 for i in range(80)}, 100: 100, 101: 100, 102: 100, 103: 100, 200: 999}


def test_additive_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 1, None)], "k long, n long, name string")
    new = spark.createDataFrame([(1, 2, "new"), (3, 4, "c")], "k long, n long, name string")
    assert rows(relational.additive_upsert(old, new, ["k"], ["n"])) == [(1, 7, "old"), (2, 1, None), (3, 4, "c")]


def test_one_bar_has_no_drawdown_and_the_range_is_a_year(spark):
    bars = [("one", 0, 5.0)] + [("long", i, 1000.0 if i == 0 else 100.0 + i % 7) for i in range(300)]
    got = {r.k: r for r in series.technicals(spark.createDataFrame(bars, "k string, day int, close double"), ["k"]).collect()}
    assert got["one"].max_drawdown is None
    assert got["long"].from_high == pytest.approx((100 + 299 % 7) / 106 - 1) and got["long"].max_drawdown == pytest.approx(-0.9)


def test_a_batch_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    write = streams.upsert_into(spark, path, ["k"], "seq", buckets=8)
    write(spark.createDataFrame([(k, 1, f"a{k}") for k in range(60)], "k long, seq long, x string"), 0)
    before = {f: f.stat().st_mtime_ns for f in Path(path).glob("bucket=*/*.parquet")}
    batch = spark.createDataFrame([(7, 2, "b"), (7, 3, "c"), (7, 0, "old")], "k long, seq long, x string")
    for _ in range(2):  # a batch may run again
        write(batch, 1)
    after = {f: f.stat().st_mtime_ns for f in Path(path).glob("bucket=*/*.parquet")}
    assert len({f.parent for f in before}) == 8 and len({f.parent for f in set(before) - set(after)}) == 1
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert rows(streams.latest_table(spark, path)) == [(k, *((3, "c") if k == 7 else (1, f"a{k}"))) for k in range(60)]
    write(batch.where("false"), 2)
    assert streams.latest_table(spark, path).count() == 60


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    # The second batch brings a late row that ties two sessions of the first one together.
    batches = [[("a", 0), ("a", 20), ("b", 5), ("a", 70)], [("a", 45), ("b", 100)], [("z", 10_000)]]
    for n, own in enumerate(batches):
        spark.createDataFrame([(u, at(m)) for u, m in own], "u string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    files = streams.file_stream(spark, str(tmp_path / "in" / "*"), "u string, t timestamp", files_per_batch=1)
    query = streams.session_stream(files, "u", "t", "30 minutes", "2 hours").writeStream.format("memory").queryName("session_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = spark.createDataFrame([(u, at(m)) for own in batches for u, m in own], "u string, t timestamp")
    want = rows(series.sessions(whole, "u", "t", "30 minutes").where("u <> 'z'"))
    assert rows(spark.table("session_rows")) == want and ("a", 4, at(0), at(70)) in want
