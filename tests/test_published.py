"""Tables published together, references of HTML, stored exports beside earlier ones, streams with late rows."""

import html
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import entities, relational, scoring
from quillon.sources import feeds, sinks
from quillon.streaming import streams


def test_tables_are_published_together(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    sinks.publish({"a": spark.range(3), "b": spark.range(2)}, path)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.publish({"a": spark.range(9), "b": bad}, path)
    assert sinks.published(spark, path, "a").count() == 3 and sinks.published(spark, path, "b").count() == 2
    sinks.publish({"a": sinks.published(spark, path, "a").where("id > 0")}, path)
    held = sinks.published(spark, path, "b")
    assert sorted(r.id for r in sinks.published(spark, path, "a").collect()) == [1, 2] and held.count() == 2
    sinks.publish({"b": held.union(held)}, path)
    sinks.vacuum(spark, path)
    assert sinks.published(spark, path, "a").count() == 2 and sinks.published(spark, path, "b").count() == 4
    assert len([p for p in (tmp_path / "p").iterdir() if p.is_dir()]) == 2


CASES = ["", "a & b", "&", "&&amp;", "&amp;lt;", "&amp", "&ampx", "&notit;", "&notin;", "&NotAName;", "&#65;&#x42;&#X43", "&#0;&#128;&#129;&#x9f;", "&#xD800;|&#x110000;|&#99999999999999999999;", "&#1;|&#11;|&#12;|&#13;|&#127;", "&#xfdd0;&#x1fffe;", "&#;&#x;&#xg", "&#x1F600;", "&CounterClockwiseContourIntegral;", "&nbsp;|&copy2", "&lt;p&gt;é&eacute;"]


def test_references_are_those_of_html(spark):
    rows = spark.createDataFrame([(x,) for x in [*CASES, None]], "x string").select("x", scalar.unescape(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == {x: html.unescape(x) for x in CASES} | {None: None}


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("&#;xX09aAmpltgnoqu 1fé"), max_size=14), min_size=100, max_size=300))
def test_references_of_any_text(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", scalar.unescape(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [html.unescape(r.x) for r in rows]


def test_like_folds_ascii_only(spark):
    rows = spark.createDataFrame([("Straße ÄRGER",), ("strasse",), (None,)], "x string").select(scalar.contains_ci(F.col("x"), "STRA"), scalar.contains_ci(F.col("x"), "är")).collect()
    assert [tuple(r) for r in rows] == [(True, False), (True, False), (None, None)]


def test_stop_lists_as_conditions_and_as_tables(spark):
    df = spark.createDataFrame([(1, "The West"), (2, "Paris"), (3, None), (4, "PARIS")], "id long, name string")
    table = spark.createDataFrame([("paris",), ("Paris",), (None,)], "name string")
    for stop in (["Paris"], table):
        assert sorted(r.id for r in entities.without_listed(df, "name", stop).collect()) == [1, 3]


def export(spark, rows):
    """Rows (number, url, first actor, n) of an export with all its columns."""
    names = ["GlobalEventID", "SOURCEURL", "Actor1CountryCode"]
    df = spark.createDataFrame([(*(str(x) for x in r[:3]), r[3]) for r in rows], [*names, "n"])
    rest = [c for c in feeds.EVENT_COLUMNS if c not in names]
    return df.select("*", *(F.lit("20240102" if c == "SQLDATE" else "").alias(c) for c in rest))


def test_known_rows_do_not_come_again(spark):
    first = feeds.stored_export(export(spark, [(1, "u", "AAA", 0), (2, "v", "BBB", 1)]), "n")
    again = feeds.stored_export(export(spark, [(2, "v", "BBB", 0), (3, "v", "AAA", 1), (4, "w", "CCC", 2)]), "n", first)
    got = {name: sorted(tuple(r) for r in df.select(df.columns[:2] if name == "event_documents" else {"documents": "url", "events": "title", "details": "global_event_id"}[name]).collect()) for name, df in again.items()}
    assert got["documents"] == [("w",)] and got["details"] == [(3,), (4,)]
    assert [t[0].split("|")[0] for t in got["events"]] == ["CCC"]
    assert [(u, t.split("|")[0]) for u, t in got["event_documents"]] == [("v", "AAA"), ("w", "CCC")]


def fed(spark, folder, schema, batches, query):
    """All rows that ``query`` gives on a stream of the batches, one file each."""
    out = []
    for k, rows in enumerate(batches):
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream = streams.file_stream(spark, str(folder), schema, "json", 1)
        run = query(stream).writeStream.option("checkpointLocation", str(folder.parent / f"{folder.name}-c")).outputMode("append").trigger(availableNow=True)
        run.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).start().awaitTermination()
    return out


def test_late_rows_count_until_the_watermark_passes(spark, tmp_path):
    at = lambda k, t: {"k": k, "t": t}
    batches = [[at(1, "2024-01-01T10:00:00"), at(1, "2024-01-02T10:00:00")], [at(1, "2024-01-01T23:00:00"), at(1, "2024-01-05T00:00:00")], [at(1, "2024-01-01T05:00:00"), at(1, "2024-01-09T00:00:00")]]
    got = fed(spark, tmp_path / "in", "k long, t timestamp", batches, lambda s: streams.daily_counts(s, ["k"], "t"))
    assert sorted((k, str(d)[:10], n) for k, d, n in got) == [(1, "2024-01-01", 2), (1, "2024-01-02", 1), (1, "2024-01-05", 1)]


def test_repeated_keys_pass_once(spark, tmp_path):
    at = lambda k, t: {"k": k, "t": t}
    batches = [[at(1, "2024-01-01T10:00:00"), at(1, "2024-01-01T11:00:00")], [at(1, "2024-01-01T12:00:00"), at(2, "2024-01-01T12:00:00")]]
    got = fed(spark, tmp_path / "in", "k long, t timestamp", batches, lambda s: streams.deduplicated(s, ["k"], "t"))
    assert sorted(k for k, _ in got) == [1, 2]


def test_baseline_is_kept_between_batches(spark, tmp_path):
    import statistics

    values = [1.0, 2.0, 1.5, 2.5, 1.0, 2.0, 1.2, 2.1, 1.8, 2.2, 1.4, 9.0, 1.1, 2.3, -7.0, 1.9]
    rows = [{"k": "a", "t": f"2024-01-{i + 1:02d}T00:00:00", "x": x} for i, x in enumerate(values)]
    got = fed(spark, tmp_path / "in", "k string, t timestamp, x double", [rows[:5], rows[5:13], rows[13:]], lambda s: streams.stateful_baseline(s, "k", "t", "x", baseline=12))
    want = []
    for i, x in enumerate(values):
        past = values[max(0, i - 12) : i]
        if len(past) >= streams.LEAST_BASELINE and abs(z := (x - statistics.fmean(past)) / statistics.stdev(past)) >= 2:
            want.append((i + 1, round(z, 9)))
    assert len(want) == 2 and sorted((t.day, round(z, 9)) for _, t, _, z in got) == want


def test_small_rules(spark):
    df = spark.createDataFrame([("long", 10.0, 100.0, 110.0), ("short", 10.0, 100.0, 110.0), ("long", 10.0, 100.0, None)], "direction string, q double, o double, p double")
    assert [r[0] for r in df.select(scoring.unrealised(*(F.col(c) for c in ("direction", "q", "o", "p")))).collect()] == [100.0, -100.0, 0.0]
    edges = spark.createDataFrame([(1, 2, 3.0), (4, 2, 5.0), (1, 4, 1.0)], "a long, b long, strength double")
    merged = relational.merge_aliases(edges, spark.createDataFrame([(4, 1)], "id long, canonical_id long"))
    assert sorted(merged.collect()[0].asDict().values()) == [1, 2, 8.0] and merged.count() == 1
