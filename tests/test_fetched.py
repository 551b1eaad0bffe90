"""Pages by an injected client, their feeds, and zip files read as streams."""

import json
import zipfile

import pytest
from test_operators import rows
from test_sources import export_row

from quillon.sources import feeds, fetched


def client(folder, documents, failing=()):
    """A fake client: documents[request] is a list of pages; those of ``failing`` fail so many times. Tries are counted in
    files, since they happen in other processes."""
    folder, failing = str(folder), dict(failing)

    def fetch(request, cursor):
        import os
        import uuid

        at = int(cursor or 0)
        own = f"{folder}/{request}-{at}"
        os.makedirs(own, exist_ok=True)
        before = len(os.listdir(own))
        open(f"{own}/{uuid.uuid4().hex}", "w").close()
        if before < failing.get((request, at), 0):
            raise OSError("no answer")
        return documents[request][at], str(at + 1) if at + 1 < len(documents[request]) else None

    return fetch


def ports(name, days):
    return [json.dumps({"features": [{"attributes": {"portid": name, "date": 1704067200000 + 86400000 * d, "n_total": d}}]}) for d in days]


@pytest.mark.parametrize("parts", [1, 50])
def test_pages_of_requests_with_retries(spark, tmp_path, parts):
    documents = {"c1": ports("c1", range(4)), "c2": ports("c2", range(3)), "c3": ports("c3", [0]), "c4": ports("c4", [9])}
    source = fetched.page_source("fake_ports", client(tmp_path, documents, {("c1", 2): 2, ("c2", 1): 9}), list(documents), tries=3, wait=0.0, partitions=parts)
    pages = fetched.fetched(spark, source)
    for _ in range(2):  # read twice, fetched once
        got = {(r.portid, r.n_total) for r in feeds.chokepoints(spark, pages).collect()}
        assert got == {("c1", d) for d in range(4)} | {("c2", 0), ("c3", 0), ("c4", 9)}
    assert rows(fetched.failures(pages)) == [("c2", 1, "OSError: no answer")]
    assert {p.name: len(list(p.iterdir())) for p in tmp_path.iterdir()} == {"c1-0": 1, "c1-1": 1, "c1-2": 3, "c1-3": 1, "c2-0": 1, "c2-1": 3, "c3-0": 1, "c4-0": 1}


def test_pages_without_end_or_requests(spark):
    stuck = fetched.fetched(spark, fetched.page_source("stuck", lambda request, cursor: ("{}", "7"), ["a"], wait=0.0))
    assert sorted((r.page, r.content, r.error) for r in stuck.collect()) == [(0, "{}", None), (1, "{}", None), (2, None, "cursor stays at 7")]
    assert fetched.fetched(spark, fetched.page_source("none", lambda request, cursor: ("", None))).count() == 0


def test_slots_as_a_stream_go_on_where_they_ended(spark, tmp_path):
    known = tmp_path / "known"
    log, path = str(tmp_path / "log"), str(known)

    def fetch(request, cursor):
        import os

        os.makedirs(log, exist_ok=True)
        open(f"{log}/{request}", "a").write("x")
        return request.upper(), None

    def count():
        return int(open(path).read())

    source = fetched.page_source("slots", fetch, slots=fetched.Slots(count, lambda k: f"s{k:03}"), wait=0.0)
    for n in (3, 5, 5):
        known.write_text(str(n))
        stream = fetched.page_stream(spark, source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        stream.awaitTermination()
        assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"S{k:03}" for k in range(n)]
    assert {p.name: p.read_text() for p in (tmp_path / "log").iterdir()} == {f"s{k:03}": "x" for k in range(5)}


def test_three_feeds_by_pages(spark, tmp_path):
    quake = json.dumps({"features": [{"properties": {"mag": 6.4, "place": "X", "time": 1704067200000}, "geometry": {"coordinates": [10.0, 20.0, 5.0]}}]})
    signal = json.dumps({"data": [[{"entityCode": "IR", "datasource": "bgp", "from": 0, "until": 600, "step": 300, "values": [1.0, None]}]]})
    news = "<?xml version='1.0' encoding='utf-8'?><rss><item><title>T é</title><link>u</link></item></rss>"
    documents = {"quake": [quake, quake], "signal": [signal], "news": [news, "<rss><item>"]}
    pages = fetched.fetched(spark, fetched.page_source("three", client(tmp_path, documents), list(documents), wait=0.0))
    of = lambda r: pages.where(f"request = '{r}'")
    assert [(r.severity, r.lat) for r in feeds.earthquakes(spark, of("quake")).collect()] == [(4, 20.0)] * 2
    assert [(r.country, r["values"]) for r in feeds.outage_signals(spark, of("signal")).collect()] == [("IR", [1.0, None])]
    assert [(r.file, r.title) for r in feeds.articles(spark, of("news")).collect()] == [("news#0", "T é")]
    assert [r.file for r in feeds.unreadable_articles(spark, of("news")).collect()] == ["news#1"]


def test_zips_are_read_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "ZIP_ROWS", 3)
    lines = ["\t".join(export_row(GlobalEventID=str(i), Actor1Name='say "x').values()) for i in range(10)]
    with zipfile.ZipFile(tmp_path / "a.export.CSV.zip", "w") as z:
        z.writestr("a.CSV", "\n".join(lines[:7]) + "\r\n\n" + "short\tline")
        z.writestr("b.CSV", "\n".join(lines[7:]))
        z.writestr("empty.CSV", "")
    got = feeds.event_export_zips(spark, str(tmp_path / "*.export.CSV.zip")).collect()
    assert len(got) == 11 and {r.GlobalEventID for r in got} == {str(i) for i in range(10)} | {"short"}
    assert all(r.Actor1Name == 'say "x' and r.SOURCEURL == "http://a.example/1" for r in got if r.GlobalEventID != "short")
    text = 'id,best,date_start,conflict_name,side_a,type_of_violence,where_description,country,extra\n1,30,2024-01-05 00:00:00,"War, ""A""\nB",S,1,W,C,z\n2,3,2024-01-05,N,S,1,W,C,z\n3,,2024-01-05,N,S,1,W,C,z\n'
    with zipfile.ZipFile(tmp_path / "ged.zip", "w") as z:
        z.writestr("ged.csv", text)
    zipped = feeds.conflicts(spark, str(tmp_path / "ged.zip"))
    full = text.replace("country,extra", "country,extra,date_end,deaths_civilians,adm_1,region,latitude,longitude,side_b")
    (tmp_path / "ged.csv").write_text(full)
    assert [r.title for r in zipped.collect()] == ['War, "A"\nB — W']
    plain = feeds.conflicts(spark, str(tmp_path / "ged.csv"))
    assert rows(zipped) == rows(plain)
