import json

from pyspark.sql import functions as F

from quillon.sources import feeds, sinks
from quillon.streaming import streams


def export_row(**over):
    row = dict.fromkeys(feeds.EVENT_COLUMNS, "")
    row |= {"GlobalEventID": "1", "SQLDATE": "20240105", "Actor1CountryCode": "IRN", "Actor2CountryCode": "ISR", "EventCode": "190", "EventRootCode": "19", "QuadClass": "4", "GoldsteinScale": "-10", "NumMentions": "12", "ActionGeo_CountryCode": "IS", "ActionGeo_Lat": "31.5", "DATEADDED": "20240106120000", "SOURCEURL": "http://a.example/1"}
    return row | over


def test_event_export(spark, tmp_path):
    assert len(feeds.EVENT_COLUMNS) == 61
    rows = [export_row(), export_row(GlobalEventID="2", GoldsteinScale="1"), export_row(GlobalEventID="3", SOURCEURL=" "), export_row(GlobalEventID="x", QuadClass="1", SOURCEURL="http://a.example/2")]
    (tmp_path / "a.tsv").write_text("\n".join("\t".join(r.values()) for r in rows))
    df = feeds.event_export(spark, str(tmp_path / "a.tsv")).withColumn("n", F.monotonically_increasing_id())
    assert feeds.filtered_export(df, [4], 10, -5.0, ["IRN"]).count() == 2
    out = feeds.stored_export(df, "n")
    assert out["documents"].count() == 2 and out["events"].count() == 1 and out["details"].count() == 2
    e = out["events"].collect()[0]
    assert (e.title, e.severity, e.event_type, e.first_seen, e.lat) == ("IRN|ISR|19|20240105|IS", 5, "fight", "2024-01-06", 31.5)


def test_file_slots(spark):
    assert feeds.file_slots(spark, "2024-01-01", "2024-01-02").count() == 192
    assert feeds.file_slots(spark, "2024-01-01", "2024-01-01", 6).count() == 4


def test_articles(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://x/1</link><description>d</description><pubDate>Mon, 1 Jan 2024 10:00:00 +0000</pubDate></item><item><title>U</title></item></channel></rss>")
    got = {r.title: r for r in feeds.articles(spark, str(tmp_path)).collect()}
    assert got["T"].body == "d" and got["T"].published_at is not None and got["U"].published_at is None


def test_json_feeds(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps(value))
        return str(tmp_path / name)

    quakes = put("q", {"features": [{"properties": {"mag": 6.4, "place": "X", "time": 1704067200000}, "geometry": {"coordinates": [10.0, 20.0, 5.0]}}, {"properties": {"place": "Y", "time": 1}, "geometry": None}]})
    q = feeds.earthquakes(spark, quakes).collect()
    assert [(r.severity, r.lat, r.lon, r.first_seen) for r in q] == [(4, 20.0, 10.0, "2024-01-01T00:00:00")]
    sig = {"entityCode": "IR", "datasource": "bgp", "from": 0, "until": 600, "step": 300, "values": [1.0, None]}
    for shape in ({"signals": [sig]}, [sig], [[sig]]):
        r = feeds.outage_signals(spark, put(f"s{len(str(shape))}", {"data": shape})).collect()
        assert [(x.country, x["from"], x.step, x["values"]) for x in r] == [("IR", 0, 300, [1.0, None])]
    who = put("w", {"value": [{"DonId": "D1", "Title": "Ebola – Congo", "PublicationDateAndTime": "2024-02-01T00:00:00Z", "Summary": "<p>a</p><p>b</p>"}, {"Title": "", "PublicationDateAndTime": "2024"}]})
    w = feeds.outbreaks(spark, who).collect()
    assert [(r.location_name, r.summary) for r in w] == [("Congo", "a b [WHO Disease Outbreak News D1]")]
    c = feeds.trade_documents(feeds.trade_flows(spark, put("c", {"data": [{"reporterCode": 1, "reporterISO": "USA", "flowCode": "M", "cmdCode": "8542", "period": "202401", "refYear": 2024, "refMonth": 1, "primaryValue": 2500000.0}]}))).collect()[0]
    assert c.url == "comtrade://USA/8542/M/202401" and c.published_at == "2024-01-01T00:00:00" and "$2.5M" in c.title
    b = [{"item": {"value": "http://e/Q1"}, "itemLabel": {"value": "Crisis"}, "start": {"value": "2008-09-01T"}, "countryLabel": {"value": k}, "coord": {"value": f"Point({i} 1)"}} for i, k in enumerate(("B", "A", "B"))]
    r = feeds.crises(spark, put("k", {"results": {"bindings": b}})).collect()[0]
    assert (r.qid, r.first_seen, r.countries, r.lon) == ("Q1", "2008-09-01", ["B", "A"], 0.0)
    p = feeds.chokepoints(spark, put("p", {"features": [{"attributes": {"portid": "c1", "date": 1704067200000, "n_total": 3}}]})).collect()[0]
    assert str(p.date) == "2024-01-01" and p.n_total == 3


def test_conflicts(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,type_of_violence,conflict_name,side_a,side_b,where_description,adm_1,latitude,longitude,country,region,date_start,date_end,deaths_civilians,best\n1,1,C,A,B,,Adm,1,2,L,R,2020-01-01 00:00,,0,300\n2,1,C,A,B,,,1,2,L,R,2020-01-01,,0,5\n3,1,C,A,B,,,1,2,L,R,2020-01-01,,0,x\n")
    r = feeds.conflicts(spark, str(tmp_path / "u.csv")).collect()
    assert [(x.title, x.severity, x.last_seen) for x in r] == [("C — Adm", 4, "2020-01-01")]


def test_export_by_month_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-05", 1), ("2024-02-05", 2), (None, 3), ("2024", 4)], "day string, x int")
    for _ in range(2):
        sinks.export_dated(df, "day", str(tmp_path / "t"))
    sinks.export_dated(df.where("x = 1"), "day", str(tmp_path / "t"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "t/dated")).collect()) == [1, 2]
    out = sinks.export_all({"ok": (df, None), "bad": (df, "nope")}, str(tmp_path / "all"))
    assert out.written == ["ok"] and set(out.errors) == {"bad"}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "k long, x double").withColumn("seq", F.monotonically_increasing_id()).write.parquet(str(src))
    seen = []
    write = streams.upsert_into(spark, str(tmp_path / "t"), ["k"], "seq")
    drain = lambda: streams.drain(streams.file_stream(spark, str(src), "k long, x double, seq long"), str(tmp_path / "c"), lambda b, n: (write(b, n), seen.append(n)))
    drain()
    drain()
    assert seen == [0]
    assert {r.k: r.x for r in streams.latest_table(spark, str(tmp_path / "t")).collect()} == {1: 2.0, 2: 5.0}
    calls = []
    assert streams.run_phases([("a", lambda: calls.append(1)), ("b", lambda: calls.append(2))], start_from="b") == ["b"] and calls == [2]
