"""Queries through the feed readers: Spark lands the given tables in a feed's own shape, and the reader makes its typed
rows of them, held against SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.lookups import quad_label
from quillon.operators import series
from quillon.plans.catalog import _folder, day, query, read
from quillon.sources import feeds
from quillon.storage import written

#: Items of one page, so that a page never grows with the table.
PAGE_ITEMS = 500


def _pages(rows: DataFrame, number: Column, item: Column, wrap: str = "%s") -> DataFrame:
    """JSON documents of PAGE_ITEMS items each, in order of a unique number; ``wrap`` is what stands around the list."""
    grouped = rows.select(F.expr("0").alias("zero"), number.cast("long").alias("ord"), item.alias("item")).groupBy(F.floor(F.col("ord") / PAGE_ITEMS).alias("page"))
    listed = grouped.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"])).alias("list"))
    return written(listed.select(F.lit("all").alias("request"), F.col("page").cast("int").alias("page"), F.format_string(wrap, "list").alias("content")), "landed")


def _s(alias: str, /, **fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items())).alias(alias)


@query("""
SELECT 'M' || format('{:.1f}', value) || ' earthquake — ' || event_type AS title, CAST(least(greatest(trunc(value) - 2, 1), 5) AS INTEGER) AS severity, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS first_seen,
  'Magnitude ' || CAST(value AS VARCHAR) || ' earthquake, ' || event_type || ', at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' UTC, depth 5.0 km.' AS summary, CAST(user_id % 90 AS DOUBLE) AS lat, CAST(user_id % 180 AS DOUBLE) AS lon
FROM events WHERE value IS NOT NULL AND value < 100""")
def feed_earthquakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value < 100")
    at = F.array((F.col("user_id") % 180).cast("double"), (F.col("user_id") % 90).cast("double"), F.lit(5.0))
    item = F.struct(_s("properties", mag=F.col("value"), place=F.col("event_type"), time=F.unix_millis(F.col("ts").cast("timestamp"))), _s("geometry", coordinates=at))
    return feeds.earthquakes(spark, _pages(e, F.col("event_id"), item, '{"features":%s}')).select("title", "severity", "first_seen", "summary", "lat", "lon")


@query("SELECT event_type AS portid, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(user_id % 50) AS BIGINT) AS n_total, max(CAST(user_id AS DOUBLE)) AS capacity FROM events GROUP BY 1, 2")
def feed_chokepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates come as milliseconds on one page in two, as text on the others."""
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    when = F.when(F.col("event_id") % 2 == 0, F.unix_millis("t").cast("string")).otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    item = F.struct(_s("attributes", portid=F.col("event_type"), portname=F.upper("event_type"), date=when, n_total=(F.col("user_id") % 50).cast("int"), capacity=F.col("user_id").cast("double")))
    rows = feeds.chokepoints(spark, _pages(e, F.col("event_id"), item, '{"features":%s}'))
    return rows.groupBy("portid", F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_total").alias("n_total"), F.max("capacity").alias("capacity"))


@query("""
WITH f AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'C' || o_custkey END AS who, CASE o_orderstatus WHEN 'F' THEN 'M' WHEN 'O' THEN 'X' ELSE 'R' END AS flow, ['8541', '8542', '9999'][1 + CAST(o_orderkey % 3 AS INTEGER)] AS cmd, o_totalprice AS v, o_orderdate AS d, o_orderkey AS k, o_orderpriority AS p FROM orders),
n AS (SELECT *, CASE flow WHEN 'M' THEN 'Import' WHEN 'X' THEN 'Export' ELSE flow END AS label, CASE cmd WHEN '8541' THEN 'semiconductor devices' WHEN '8542' THEN 'integrated circuits' ELSE cmd END AS short FROM f)
SELECT 'comtrade://' || who || '/' || cmd || '/' || flow || '/' || strftime(d, '%Y%m') AS url, who || ' ' || label || ' HS' || cmd || ' (' || short || ') ' || strftime(d, '%Y%m') || ': $' || format('{:,.1f}', v / 1e6) || 'M' AS title,
  who || ' ' || lower(label) || ' of HS ' || cmd || ' — ' || short || '. Partner: ' || p || '. Period ' || strftime(d, '%Y%m') || '. Trade value: $' || format('{:,.0f}', v) || '.' || CASE WHEN k % 5 > 0 THEN ' Net weight: ' || format('{:,.0f}', CAST(k % 5 * 1000 AS DOUBLE)) || ' kg.' ELSE '' END AS body, strftime(d, '%Y-%m-01T00:00:00') AS published_at
FROM n""")
def feed_trade_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = F.col
    fields = {
        "reporterCode": c("o_custkey").cast("int"), "reporterISO": F.when(c("o_custkey") % 3 != 0, F.concat(F.lit("C"), c("o_custkey").cast("string"))),
        "flowCode": F.when(c("o_orderstatus") == "F", "M").when(c("o_orderstatus") == "O", "X").otherwise("R"), "cmdCode": F.get(F.array(F.lit("8541"), F.lit("8542"), F.lit("9999")), (c("o_orderkey") % 3).cast("int")),
        "partnerDesc": c("o_orderpriority"), "period": F.date_format("o_orderdate", "yyyyMM"), "refYear": F.year("o_orderdate"), "refMonth": F.month("o_orderdate"), "primaryValue": c("o_totalprice"), "netWgt": (c("o_orderkey") % 5 * 1000).cast("double"),
    }
    flows = feeds.trade_flows(spark, _pages(o, c("o_orderkey"), F.struct(*(v.alias(k) for k, v in fields.items())), '{"data":%s}'))
    return feeds.trade_documents(flows).select("url", "title", "body", "published_at")


_STRIPPED = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&hellip;', '…'), '&ndash;', '–'), '&mdash;', '—'), '&rsquo;', '’'), '&lsquo;', '‘'), '&ldquo;', '“'), '&rdquo;', '”'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"""
WITH d AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'Fever – ' || source WHEN 1 THEN 'Fever – 2024' WHEN 2 THEN 'Fever' ELSE 'A – B – ' || lang END AS title, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS day FROM documents WHERE doc_id % 7 <> 6)
SELECT title, day AS first_seen, CASE WHEN doc_id % 4 IN (0, 3) THEN CASE doc_id % 4 WHEN 0 THEN source ELSE lang END END AS location_name, md5(trim(substring({_STRIPPED.format("'<p>' || coalesce(text, '') || '</p>'")}, 1, 2000) || ' [WHO Disease Outbreak News ' || doc_id || ']')) AS digest
FROM d WHERE day BETWEEN '2024-02-01' AND '2024-09-30'""")
def feed_outbreaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in seven has no title and is passed over."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    title = F.when(k % 7 == 6, "").when(k % 4 == 0, F.concat(F.lit("Fever – "), "source")).when(k % 4 == 1, "Fever – 2024").when(k % 4 == 2, "Fever").otherwise(F.concat(F.lit("A – B – "), "lang"))
    when = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"), F.lit("T08:00:00Z"))
    item = F.struct(k.cast("string").alias("DonId"), title.alias("Title"), when.alias("PublicationDateAndTime"), F.concat(F.lit("<p>"), F.coalesce("text", F.lit("")), F.lit("</p>")).alias("Summary"))
    rows = feeds.outbreaks(spark, _pages(d, k, item, '{"value":%s}'), "2024-02-01", "2024-09-30")
    return rows.select("title", "first_seen", "location_name", F.md5("summary").alias("digest"))


@query("""
SELECT o_orderpriority || ' in ' || o_custkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS first_seen, CASE WHEN o_orderkey % 2 = 0 THEN 'disaster' ELSE o_orderstatus END || CASE WHEN o_orderkey % 3 = 0 THEN ': price ' || o_orderkey ELSE ' — ' || coalesce(CASE WHEN o_orderkey % 5 > 0 THEN 'land ' || o_custkey END, '') || ', ' || strftime(o_orderdate, '%Y-%m-%d') || '.' END || ' [ReliefWeb]' AS summary,
  CASE WHEN o_orderkey % 5 > 0 THEN 'land ' || o_custkey END AS location_name, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 90 AS DOUBLE) END AS lat FROM orders""")
def feed_disasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    country = F.when(k % 5 > 0, F.struct(F.concat(F.lit("land "), F.col("o_custkey").cast("string")).alias("name"), _s("location", lat=(F.col("o_custkey") % 90).cast("double"), lon=F.lit(1.0))))
    when = day("o_orderdate")
    fields = _s("fields", name=F.concat(F.lit(" "), "o_orderpriority", F.lit(" in "), F.col("o_custkey").cast("string")), description=F.when(k % 3 == 0, F.concat(F.lit(" price "), k.cast("string"))), date=F.struct(F.when(k % 4 > 0, F.concat(when, F.lit("T00:00:00"))).alias("event"), when.alias("created")), primary_country=country, primary_type=F.when(k % 2 == 1, F.struct(F.col("o_orderstatus").alias("name"))))
    return feeds.disasters(spark, _pages(o, k, F.struct(fields), '{"data":%s}')).select("title", "first_seen", "summary", "location_name", "lat")


@query("""
WITH o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey), p AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM o GROUP BY 1, 2),
n AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS countries FROM p GROUP BY 1)
SELECT 'Q' || o.o_custkey AS qid, any_value(c_name) AS title, any_value(c_mktsegment) AS description, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_seen, any_value(countries) AS countries, arg_min(CAST(o_orderkey % 90 AS DOUBLE), o_orderkey) FILTER (WHERE o_orderkey % 3 > 0) AS lat FROM o JOIN n ON n.o_custkey = o.o_custkey GROUP BY 1""")
def feed_crises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bindings of a customer are on one page, in order of keys: a customer has few orders."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k, v = F.col("o_orderkey"), lambda c: F.struct(c.cast("string").alias("value"))
    # The page goes by customer, the place on it by order.
    point = F.when(k % 3 > 0, F.struct(F.concat(F.lit("Point("), (k % 180).cast("string"), F.lit(" "), (k % 90).cast("string"), F.lit(")")).alias("value")))
    item = F.struct(v(F.concat(F.lit("http://e.example/Q"), F.col("c_custkey").cast("string"))).alias("item"), v(F.col("c_name")).alias("itemLabel"), v(F.col("c_mktsegment")).alias("itemDescription"), v(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("start"), v(F.col("o_orderpriority")).alias("countryLabel"), point.alias("coord"))
    of = o.select(F.floor(F.col("c_custkey") / 20).cast("int").alias("page"), k.alias("ord"), item.alias("item"))
    listed = of.groupBy("page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"])).alias("list"))
    pages = written(listed.select(F.lit("all").alias("request"), "page", F.format_string('{"results":{"bindings":%s}}', "list").alias("content")), "landed")
    return feeds.crises(spark, pages).select("qid", "title", "description", "first_seen", F.array_join("countries", ",").alias("countries"), "lat")


@query("""
WITH s AS (SELECT event_type AS country, 'd' || user_id % 3 AS datasource, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, CASE event_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 60000 ELSE 300 END AS step, value AS x FROM events),
v AS (SELECT country, datasource, CAST(make_timestamp(t * 1000000) AS DATE) AS day, x FROM s UNION ALL SELECT country, datasource, CAST(make_timestamp((t + 2 * step) * 1000000) AS DATE), 1.0 FROM s)
SELECT country, datasource, strftime(day, '%Y-%m-%d') AS day, round(avg(x), 10) AS mean FROM v WHERE x IS NOT NULL GROUP BY 1, 2, 3""")
def feed_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals in the three shapes of answers, with a step, a native one or none; a slot without a value in the middle."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    fields = {"entityCode": F.col("event_type"), "datasource": F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")), "from": F.unix_seconds(F.col("ts").cast("timestamp")), "step": F.when(k % 3 == 0, 300), "nativeStep": F.when(k % 3 == 1, 60000), "values": F.array("value", F.lit(None).cast("double"), F.lit(1.0))}
    pages = _pages(e, k, F.struct(*(v.alias(c) for c, v in fields.items())))
    shape = F.col("page") % 3
    content = F.when(shape == 0, F.format_string('{"data":{"signals":%s}}', "content")).when(shape == 1, F.format_string('{"data":%s}', "content")).otherwise(F.format_string('{"data":[%s]}', "content"))
    means = series.slot_means(feeds.outage_signals(spark, pages.withColumn("content", content)), ["country", "datasource"], "from", "step", "values")
    return means.select("country", "datasource", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("mean", 10).alias("mean"))


@query("""
WITH c AS (SELECT *, CAST(l_quantity AS INTEGER) * 25 AS deaths, strftime(l_shipdate, '%Y-%m-%d') AS d0, strftime(l_shipdate + to_days(l_linenumber % 2), '%Y-%m-%d') AS d1, CASE l_linenumber % 3 WHEN 0 THEN 'town, "' || l_suppkey || '"' WHEN 1 THEN 'province ' || l_suppkey ELSE 'land' END AS place, CASE l_returnflag WHEN 'A' THEN 'State-based conflict' WHEN 'N' THEN 'Non-state conflict' ELSE 'One-sided violence' END AS kind FROM lineitem)
SELECT 'war ' || l_suppkey || ' — ' || place AS title, d0 AS first_seen, d1 AS last_seen, place || ', land' AS location_name, CASE WHEN deaths >= 1000 THEN 5 WHEN deaths >= 250 THEN 4 WHEN deaths >= 100 THEN 3 ELSE 2 END AS severity,
  kind || ': side vs ?, ' || place || ', land (Asia), ' || CASE WHEN d0 = d1 THEN 'on ' || d0 ELSE d0 || ' to ' || d1 END || '. ' || deaths || ' deaths (best estimate, 0 civilians). UCDP GED id ' || l_orderkey || '.' AS summary
FROM c WHERE deaths >= 500 AND d0 BETWEEN '1997-01-01' AND '1999-12-31'""")
def feed_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = read(spark, sf_dir, "lineitem"), F.col
    sup = c("l_suppkey").cast("string")
    fields = {
        "id": c("l_orderkey"), "conflict_name": F.concat(F.lit("war "), sup), "type_of_violence": F.when(c("l_returnflag") == "A", 1).when(c("l_returnflag") == "N", 2).otherwise(3), "side_a": F.lit(" side"), "side_b": F.lit(None),
        "where_description": F.when(c("l_linenumber") % 3 == 0, F.concat(F.lit('town, "'), sup, F.lit('"'))), "adm_1": F.when(c("l_linenumber") % 3 == 1, F.concat(F.lit("province "), sup)), "country": F.lit("land"), "region": F.lit("Asia"), "latitude": F.lit(1.5), "longitude": F.lit(None),
        "date_start": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "date_end": F.when(c("l_linenumber") % 2 == 1, F.date_format(F.date_add("l_shipdate", 1), "yyyy-MM-dd HH:mm:ss")), "best": c("l_quantity").cast("int") * 25, "deaths_civilians": F.lit(None),
    }
    path = _folder(spark, "conflicts")
    rows.select(*(v.cast("string").alias(k) for k, v in fields.items())).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False)
    return feeds.conflicts(spark, path, 500, "1997-01-01", "1999-12-31").select("title", "first_seen", "last_seen", "location_name", "severity", "summary")


@query("""
SELECT event_type AS area, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(coalesce(sum(CASE WHEN user_id % 9 > 0 THEN value END), 0), 4) AS frp_sum, max(CASE WHEN user_id % 9 > 0 THEN value END) AS frp_max, round(avg(user_id % 90), 10) AS lat
FROM events WHERE user_id % 11 > 0 GROUP BY 1, 2""")
def feed_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some detections have no date, some a power that is no number."""
    e, path, c = read(spark, sf_dir, "events"), _folder(spark, "fires"), F.col
    e.select(F.when(c("user_id") % 11 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("acq_date"), F.when(c("user_id") % 9 > 0, c("value").cast("string")).otherwise("nan").alias("frp"), (c("user_id") % 90).alias("latitude"), (c("user_id") % 180).alias("longitude"), c("event_type").alias("satellite")).write.csv(path, header=True)
    out = feeds.fire_metrics(spark, path, c("satellite"))
    return out.select("area", F.date_format("date", "yyyy-MM-dd").alias("day"), "n", F.round("frp_sum", 4).alias("frp_sum"), "frp_max", F.round("lat", 10).alias("lat"))


@query("""
SELECT 'T & ' || doc_id AS title, CASE WHEN doc_id % 6 > 0 THEN 'http://a.example/?a=1&b=' || doc_id END AS url, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE strftime(TIMESTAMP '2024-01-01 10:00:00' + to_days(CAST(doc_id % 300 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') END AS published_at, sha256(coalesce(md5(text), '')) AS content_hash
FROM documents WHERE doc_id % 5 = 0 OR doc_id % 300 >= 60""")
def feed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to write dates, unreadable ones, items without a link; those before March are too old."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    at = F.to_timestamp(F.lit("2024-01-01 10:00:00")) + F.make_dt_interval((k % 300).cast("int"))
    when = F.when(k % 5 == 0, "soon").when(k % 5 < 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
    link = F.when(k % 6 > 0, F.concat(F.lit("<link>http://a.example/?a=1&amp;b="), k.cast("string"), F.lit("</link>"))).otherwise("")
    item = F.concat(F.lit("<item><title>T &amp; "), k.cast("string"), F.lit("</title>"), link, F.lit("<description>"), F.coalesce(F.md5("text"), F.lit("")), F.lit("</description><pubDate>"), when, F.lit("</pubDate></item>"))
    listed = d.groupBy(F.floor(k / PAGE_ITEMS).cast("int").alias("page")).agg(F.array_join(F.collect_list(item), "").alias("x"))
    pages = written(listed.select(F.lit("all").alias("request"), "page", F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")).alias("content")), "landed")
    found = feeds.recent(feeds.articles(spark, pages), F.lit("2024-03-01").cast("timestamp"))
    return found.select("title", "url", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), "content_hash")


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of the 61-column export; one url for two rows, one key for many, some rows without a url."""
    e, path, c = read(spark, sf_dir, "events"), _folder(spark, "export"), F.col
    own = {
        "GlobalEventID": c("event_id").cast("string"), "SQLDATE": F.date_format("ts", "yyyyMMdd"), "Actor1CountryCode": F.concat(F.lit("A"), (c("user_id") % 7).cast("string")), "Actor2CountryCode": F.concat(F.lit("B"), (c("user_id") % 3).cast("string")), "Actor1Name": c("event_type"),
        "EventCode": F.lit("190"), "EventRootCode": F.lpad((c("user_id") % 22).cast("string"), 2, "0"), "QuadClass": (c("user_id") % 4 + 1).cast("string"), "GoldsteinScale": (c("value") - 5).cast("string"), "NumMentions": (c("user_id") % 30).cast("string"), "ActionGeo_FullName": F.when(c("user_id") % 2 == 0, F.concat(F.lit("town "), c("event_type"))),
        "ActionGeo_CountryCode": F.lit("IS"), "ActionGeo_Lat": F.when(c("user_id") % 2 == 0, "31.5"), "DATEADDED": F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("120000")), "SOURCEURL": F.when(c("event_id") % 10 == 0, " ").otherwise(F.concat(F.lit("http://a.example/"), F.floor(c("event_id") / 2).cast("string"))),
    }
    e.select(*(own.get(name, F.lit("")).alias(name) for name in feeds.EVENT_COLUMNS)).write.csv(path, sep="\t", quote="", emptyValue="", nullValue="")
    return feeds.filtered_export(feeds.event_export(spark, path), [3, 4], 5, 3.0).withColumn("seq", F.col("GlobalEventID").cast("long"))


_EXPORT_SQL = """
WITH r AS (SELECT *, 'http://a.example/' || event_id // 2 AS url, 'A' || user_id % 7 || '|B' || user_id % 3 || '|' || lpad(CAST(user_id % 22 AS VARCHAR), 2, '0') || '|' || strftime(ts, '%Y%m%d') || '|IS' AS key, CAST(CAST(value - 5 AS VARCHAR) AS DOUBLE) AS g FROM events
  WHERE user_id % 4 + 1 IN (3, 4) AND user_id % 30 >= 5 AND coalesce(value - 5, 0) <= 3 AND event_id % 10 > 0)
"""


@query(_EXPORT_SQL + """
SELECT key AS title, strftime(ts, '%Y-%m-%d') AS first_seen, CASE user_id % 22 WHEN 1 THEN 'statement' WHEN 2 THEN 'appeal' WHEN 3 THEN 'cooperate_intent' WHEN 4 THEN 'consult' WHEN 5 THEN 'diplomatic' WHEN 6 THEN 'material_coop' WHEN 7 THEN 'aid' WHEN 8 THEN 'yield' WHEN 9 THEN 'investigate' WHEN 10 THEN 'demand' WHEN 11 THEN 'disapprove' WHEN 12 THEN 'reject' WHEN 13 THEN 'threaten' WHEN 14 THEN 'protest' WHEN 15 THEN 'force_posture' WHEN 16 THEN 'reduce_relations' WHEN 17 THEN 'coerce' WHEN 18 THEN 'assault' WHEN 19 THEN 'fight' WHEN 20 THEN 'mass_violence' ELSE 'other' END AS event_type,
  CASE WHEN coalesce(g, 0) = 0 THEN 1 ELSE CAST(least(greatest(floor(abs(g) / 2) + 1, 1), 5) AS INTEGER) END AS severity, CASE WHEN user_id % 2 = 0 THEN 'town ' || event_type END AS location_name, CASE WHEN user_id % 2 = 0 THEN 31.5::DOUBLE END AS lat
FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1""")
def feed_export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.stored_export(_export(spark, sf_dir), "seq")["events"].select("title", "first_seen", "event_type", "severity", "location_name", "lat")


@query(_EXPORT_SQL + """, d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id) = 1), l AS (SELECT url, count(DISTINCT key) AS n_events FROM r GROUP BY 1)
SELECT d.url, 'GDELT: ' || event_type || ' →  [190]' AS title, strftime(ts, '%Y-%m-%d') AS published_at, sha256(d.url) AS content_hash, n_events FROM d JOIN l ON l.url = d.url""")
def feed_export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.stored_export(_export(spark, sf_dir), "seq")
    return out["documents"].drop("origin").join(out["event_documents"].groupBy("url").agg(F.count(F.lit(1)).alias("n_events")), "url")


@query(_EXPORT_SQL + """
SELECT event_id AS global_event_id, key AS event_title, CASE user_id % 4 WHEN 2 THEN 'verbal conflict' ELSE 'material conflict' END AS label, coalesce(g, 0) AS goldstein, CAST(user_id % 30 AS INTEGER) AS num_mentions FROM r WHERE event_id > 0""")
def feed_export_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = feeds.stored_export(_export(spark, sf_dir), "seq")["details"]
    return details.select("global_event_id", "event_title", quad_label(F.col("quad_class")).alias("label"), "goldstein", "num_mentions")
