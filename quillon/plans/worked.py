"""Queries over entities, forecasts, scenarios, portfolios and the seams for models, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import entities, relational, scoring, series, shape, trading, vectors
from quillon.plans.catalog import query, read


def _one_of(key: Column, *values: str | Column) -> Column:
    return F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), F.pmod(key, F.lit(len(values))).cast("int"))


# Entities ----------------------------------------------------------------------------------------------------------


@query(r"""
WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'President  Anna Sur' WHEN 1 THEN 'anna sur' WHEN 2 THEN 'Dr. Prime Minister Bob Sur' WHEN 3 THEN 'Sur' ELSE 'Bob Sur' END || CASE c_custkey % 5 WHEN 2 THEN c_custkey % 74 WHEN 4 THEN c_custkey % 74 ELSE c_custkey % 37 END AS name, c_custkey * 7919 % 101 AS m FROM customer),
k AS (SELECT *, regexp_replace(lower(regexp_replace(name, '\s+', ' ', 'g')), '^((president|dr\.|prime minister) )+', '') AS key FROM e),
t AS (SELECT key, arg_max(id, m * 1000000000 - id) AS target, max(m) AS m, split_part(key, ' ', 2) AS surname FROM k WHERE contains(key, ' ') GROUP BY key),
r AS (SELECT *, row_number() OVER w AS r, lead(m) OVER w AS next_m FROM t WINDOW w AS (PARTITION BY surname ORDER BY m DESC, target))
SELECT id, target AS canonical_id FROM k JOIN t USING (key) WHERE id <> target
UNION ALL SELECT id, target FROM k JOIN r ON k.key = r.surname WHERE r = 1 AND (next_m IS NULL OR next_m <= 0 OR r.m >= 3 * next_m)""")
def people_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = _one_of(k, "President  Anna Sur", "anna sur", "Dr. Prime Minister Bob Sur", "Sur", "Bob Sur")
    number = F.when((k % 5).isin(2, 4), k % 74).otherwise(k % 37)
    people = read(spark, sf_dir, "customer").select(k.alias("id"), F.concat(name, number.cast("string")).alias("name"), (k * 7919 % 101).alias("mentions"))
    return entities.canonical_people(people)


@query("""
WITH e AS (SELECT c_custkey AS id, ['USA', 'american', 'United States', 'British', 'england', 'Land ' || c_nationkey, 'land ' || c_nationkey][1 + c_custkey % 7] AS name, c_custkey * 7919 % 101 AS m FROM customer),
l AS (SELECT *, CASE lower(name) WHEN 'usa' THEN 'United States' WHEN 'american' THEN 'United States' WHEN 'british' THEN 'United Kingdom' WHEN 'england' THEN 'United Kingdom' ELSE name END AS label FROM e),
t AS (SELECT lower(label) AS key, arg_max(id, m * 1000000000 - id) AS canonical_id, min(CASE WHEN lower(name) <> lower(label) THEN label END) AS known FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT id, canonical_id, coalesce(known, label) AS label FROM l JOIN t ON lower(label) = key""")
def places_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    name = _one_of(k, "USA", "american", "United States", "British", "england", F.concat(F.lit("Land "), n), F.concat(F.lit("land "), n))
    return entities.canonical_places(read(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), (k * 7919 % 101).alias("mentions")))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"), F.when(k % 2 == 0, "person").otherwise("place").alias("entity_type"), (k % 10).alias("canonical_entity_id"))


_TYPED_SQL = """
WITH e AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS name, CASE WHEN s_nationkey < 10 THEN 'org' WHEN s_suppkey % 2 = 0 THEN 'person' ELSE 'place' END AS entity_type FROM supplier),
k AS (SELECT id, min(id) OVER (PARTITION BY name, entity_type) AS kept FROM e)
"""


def _retyped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    mentions = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_linenumber").alias("mentions"))
    kind = F.when(F.substring("name", 2, 9).cast("int") < 10, "org").otherwise(F.col("entity_type"))
    return entities.retyped(mentions, _typed(spark, sf_dir).drop("canonical_entity_id"), kind)


@query(_TYPED_SQL + "SELECT l_orderkey AS document_id, kept AS entity_id, CAST(sum(l_linenumber) AS BIGINT) AS mentions FROM lineitem JOIN k ON id = l_suppkey GROUP BY 1, 2")
def mentions_retyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of ten nations become one kind of thing; those that then collide are one, with the mentions of all."""
    return _retyped(spark, sf_dir)[1]


@query(_TYPED_SQL + """, x AS (SELECT a.kept AS x, b.kept AS y, l_quantity FROM lineitem JOIN k a ON a.id = l_suppkey JOIN k b ON b.id = l_partkey % (SELECT count(*) FROM supplier))
SELECT least(x, y) AS entity_a, greatest(x, y) AS entity_b, max(l_quantity) AS strength FROM x WHERE x <> y GROUP BY 1, 2""")
def edges_repointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _retyped(spark, sf_dir)[2]
    n = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    edges = read(spark, sf_dir, "lineitem").join(F.broadcast(n)).select(F.col("l_suppkey").alias("entity_a"), (F.col("l_partkey") % F.col("n")).alias("entity_b"), F.col("l_quantity").alias("strength"))  # one row
    return entities.repointed(edges, moved)


@query("""
SELECT s_suppkey AS id, 'n' || s_nationkey AS name, CASE WHEN s_suppkey % 10 NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 7, 15)) THEN s_suppkey % 10 END AS canonical_entity_id FROM supplier WHERE s_nationkey NOT IN (3, 7, 15)""")
def entities_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.without_noise(_typed(spark, sf_dir), ["N3", "n7", "n15"]).select("id", "name", "canonical_entity_id")


_PLACES_SQL = """
WITH c AS (SELECT 'c' || c_custkey AS q, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS y FROM customer WHERE c_custkey % 2 = 0),
e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN 'c' || o_custkey END AS place, CASE WHEN o_orderkey % 7 = 0 THEN 1.0::DOUBLE END AS y FROM orders)
"""


def _geocoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    name = lambda k: F.concat(F.lit("c"), F.col(k).cast("string"))
    cache = read(spark, sf_dir, "customer").where(c % 2 == 0).select(name("c_custkey").alias("query"), F.when(c % 3 == 0, F.col("c_acctbal")).alias("lat"), F.when(c % 3 == 0, F.lit(2.0)).alias("lon"))
    at = F.when(o % 7 == 0, F.lit(1.0))
    events = read(spark, sf_dir, "orders").select(o.alias("id"), F.when(o % 9 > 0, name("o_custkey")).alias("location_name"), at.alias("lat"), at.alias("lon"))
    return entities.geocoded(events, cache, 50)


@query(_PLACES_SQL + "SELECT id, place AS location_name, coalesce(e.y, c.y) AS lat, coalesce(e.y, CASE WHEN c.y IS NOT NULL THEN 2.0 END) AS lon FROM e LEFT JOIN c ON q = place")
def events_geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geocoded(spark, sf_dir)[0].select("id", "location_name", "lat", "lon")


@query(_PLACES_SQL + "SELECT place AS location_name, count(*) AS n FROM e LEFT JOIN c ON q = place WHERE e.y IS NULL AND place IS NOT NULL AND q IS NULL GROUP BY 1 ORDER BY n DESC, place LIMIT 50")
def geocode_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty places most asked for that no lookup has answered or missed: the budget of lookups is the feature."""
    return _geocoded(spark, sf_dir)[1]


@query("""
WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'Georgia' ELSE 'E' || c_custkey % 200 END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'place' ELSE 'person' END AS t, c_custkey * 7919 % 101 AS m FROM customer),
l AS (SELECT DISTINCT name, t, CASE WHEN name = 'Georgia' THEN 'Q1' ELSE 'Q' || CAST(substr(name, 2) AS INTEGER) % 40 END AS q, CASE WHEN name = 'Georgia' THEN 'place' WHEN CAST(substr(name, 2) AS INTEGER) % 3 = 0 THEN t END AS f FROM e),
j AS (SELECT e.*, coalesce(f = e.t, false) AS ok, CASE WHEN coalesce(f = e.t, false) OR e.name <> 'Georgia' THEN q END AS q FROM e JOIN l USING (name, t)),
b AS (SELECT *, first_value(id) OVER (PARTITION BY q ORDER BY ok DESC, m DESC, id) AS best FROM j)
SELECT id, name, CASE WHEN q IS NOT NULL AND best = id THEN q END AS wikidata_qid, CASE WHEN q IS NOT NULL AND best <> id THEN best END AS canonical_entity_id FROM b""")
def qids_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, "Georgia").otherwise(F.concat(F.lit("E"), (k % 200).cast("string")))
    own = read(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), F.when(k % 2 == 0, "place").otherwise("person").alias("entity_type"), (k * 7919 % 101).alias("mentions"), F.lit(None).cast("long").alias("canonical_entity_id"))
    number, georgia = F.substring("name", 2, 9).try_cast("int"), F.col("name") == "Georgia"
    qid = F.when(georgia, "Q1").otherwise(F.concat(F.lit("Q"), (number % 40).cast("string")))
    lookup = own.select("name", "entity_type", qid.alias("qid"), F.when(georgia, "place").when(number % 3 == 0, F.col("entity_type")).alias("found_type")).distinct()
    return entities.linked_qids(own, lookup).select("id", "name", "wikidata_qid", "canonical_entity_id")


# Seams for models --------------------------------------------------------------------------------------------------


def _long_words() -> Callable[[list[str]], list[list[tuple[str, str]]]]:
    """A stand-in for a model of names: capitalised words of eight letters or more, by their first letter."""
    import re

    word = re.compile(r"(?<![A-Za-z])[A-Z][a-z]{7,}(?![A-Za-z])")
    return lambda texts: [[(w, "early" if w[0] < "N" else "late") for w in word.findall(t)] for t in texts]


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM documents)
SELECT doc_id AS document_id, name, CASE WHEN name < 'N' THEN 'person' ELSE 'place' END AS entity_type, count(*) AS mentions FROM w WHERE regexp_full_match(name, '[A-Z][a-z]{7,}') GROUP BY 1, 2""")
def entities_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return entities.extracted(docs, _long_words, {"early": "person", "late": "place"}, [])


def _letters() -> Callable[[list[str]], np.ndarray]:
    """A stand-in for an embedding model: how often eight letters occur."""
    return lambda texts: np.array([[t.count(c) for c in "abcdefgh"] for t in texts])


@query("""
WITH c AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE [""" + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "abcdefgh") + """] END AS v FROM documents),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM c)
SELECT doc_id, CASE WHEN v IS NULL THEN 'skipped' ELSE 'embedded' END AS status, round(CAST(CAST(v[1] / greatest(n, 1) AS FLOAT) AS DOUBLE), 4) AS first, round(CAST(CAST(v[8] / greatest(n, 1) AS FLOAT) AS DOUBLE), 4) AS last, CASE WHEN v IS NOT NULL THEN len(v) END AS dims FROM n""")
def texts_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("text", F.when(F.trim("text") != "", F.col("text")))
    out = vectors.embedded(docs, _letters, "doc_id")
    at = lambda i: F.round(F.get("vector", F.lit(i)).cast("double"), 4)
    return out.select(F.col("id").alias("doc_id"), "status", at(0).alias("first"), at(7).alias("last"), F.when(F.col("vector").isNotNull(), F.size("vector")).cast("long").alias("dims"))


# Forecasts and scenarios -------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT CASE WHEN l_discount * 10 > 0.95 THEN 'probability' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'macro_area' WHEN l_returnflag = 'R' THEN 'prediction_type' WHEN l_linenumber = 7 THEN 'horizon_date' ELSE 'valid' END AS reason, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT reason, count(*) AS n, sum(l_quantity) AS quantity FROM p GROUP BY 1""")
def predictions_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    p = F.col("l_discount") * 10
    asked = lines.select(F.when(p > 0.95, 1.5).otherwise(p).alias("probability"), F.col("o_orderpriority").alias("macro_area"), F.col("l_returnflag").alias("prediction_type"), F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("horizon_date"), "l_quantity")
    good, bad = scoring.valid_predictions(asked, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], ["A", "N"])
    rows = good.withColumn("reason", F.lit("valid")).unionByName(bad)
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT DISTINCT l_orderkey AS prediction_id, l_returnflag AS domain FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def prediction_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_returnflag").alias("domains"))
    return scoring.prediction_domains(own, ["R", "A", "X"])


_SCENARIOS_SQL = "s AS (SELECT l_orderkey * 10 + l_linenumber AS scenario_id, l_orderkey AS set_id, l_discount AS p, l_tax AS q, l_linestatus, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) = 1)"


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = relational.first_wins(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scenario_id"), F.col("l_orderkey").alias("set_id"), F.col("l_discount").alias("probability"), F.col("l_tax").alias("asked"), F.when(F.col("l_linestatus") == "F", "active").otherwise("resolved").alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("horizon_date"))


@query(f"WITH {_SCENARIOS_SQL}, r AS (SELECT *, l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '1998-01-01' AND scenario_id % 3 > 0 AND abs(q - p) > 0.02 AS revised FROM s) SELECT scenario_id, revised, CASE WHEN revised THEN q ELSE p END AS probability FROM r")
def scenarios_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scenarios(spark, sf_dir)
    answers = own.where("scenario_id % 3 > 0").select("scenario_id", F.col("asked").alias("probability"))
    return scoring.reviewed(own.drop("asked"), answers, F.lit("1998-01-01"), 0.02).select("scenario_id", "revised", "probability")


@query(f"WITH {_SCENARIOS_SQL}, w AS (SELECT set_id, min(scenario_id) AS winner FROM s WHERE set_id % 2 = 0 GROUP BY 1) SELECT scenario_id, CASE WHEN winner IS NOT NULL THEN scenario_id = winner END AS outcome FROM s LEFT JOIN w USING (set_id)")
def scenarios_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scenarios(spark, sf_dir)
    winners = own.where("set_id % 2 = 0").groupBy("set_id").agg(F.min("scenario_id").alias("scenario_id"))
    return scoring.resolved(own, winners).select("scenario_id", "outcome")


@query("""
WITH a AS (SELECT 0 AS part, 'order' AS kind, row_number() OVER (ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS place, CAST(o_orderkey AS VARCHAR) AS text FROM orders QUALIFY place <= 8
UNION ALL SELECT 1, 'event', row_number() OVER (ORDER BY ts DESC, event_type || ' ' || event_id), event_type || ' ' || event_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_type || ' ' || event_id) <= 6
UNION ALL SELECT 2, 'place', row_number() OVER (ORDER BY n_nationkey, n_name), n_name FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey, n_name) <= 30)
SELECT 'E' || row_number() OVER (ORDER BY part, place) AS evidence_id, kind, text FROM a""")
def dossier_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    parts = [
        ("order", t("orders").select("o_totalprice", F.col("o_orderkey").cast("string").alias("text")), F.col("o_totalprice").desc(), 8),
        ("event", t("events").select("ts", F.concat_ws(" ", "event_type", "event_id").alias("text")), F.col("ts").desc(), 6),
        ("place", t("nation").select("n_nationkey", F.col("n_name").alias("text")), F.col("n_nationkey").asc(), 30),
    ]
    return entities.dossier(parts)


# Portfolios and series ---------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT l_suppkey AS id, (l_extendedprice - l_quantity * 1500) / 100 AS pnl FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 10 > 0),
g AS (SELECT id, count(*) AS n, sum(pnl) AS pnl, avg(CASE WHEN pnl > 0 THEN 100.0 ELSE 0 END) AS w FROM t GROUP BY 1)
SELECT s_suppkey AS id, coalesce(n, 0) AS n_closed, round(coalesce(pnl, 0), 2) AS pnl, round(w, 6) AS win_pct, round(coalesce(pnl, 0) / 1000, 4) AS return_pct FROM supplier LEFT JOIN g ON id = s_suppkey""")
def portfolio_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = read(spark, sf_dir, "lineitem").where("l_suppkey % 10 > 0").select(F.col("l_suppkey").alias("portfolio_id"), F.when(F.col("l_linestatus") == "F", (F.col("l_extendedprice") - F.col("l_quantity") * 1500) / 100).alias("pnl"))
    out = scoring.portfolio_results(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), trades)
    return out.select("id", F.col("n_closed").cast("long").alias("n_closed"), F.round("pnl", 2).alias("pnl"), F.round("win_pct", 6).alias("win_pct"), F.round("return_pct", 4).alias("return_pct"))


@query("""
WITH b AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, sum(user_id) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM b)
SELECT event_type, CASE WHEN count(*) >= 21 THEN round(avg(v) FILTER (WHERE r <= 21) / avg(v), 8) END AS volume_ratio FROM r WHERE r <= 63 GROUP BY 1""")
def volume_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = read(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("user_id").alias("volume"))
    return series.volume_ratio(bars, ["event_type"]).select("event_type", F.round("volume_ratio", 8).alias("volume_ratio"))


# Tables and values -------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS k, o_totalprice AS v FROM orders WHERE o_custkey % 3 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def inserted_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer, but for customers that the table has."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_totalprice").alias("v"))
    existing = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return relational.insert_if_absent(relational.first_wins(orders, ["k"], ["o_orderkey"]), existing, ["k"]).select("k", "v")


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, CASE WHEN page_id % 48 = 0 THEN '0min' WHEN page_id % 500 < 48 THEN CAST(page_id % 500 AS VARCHAR) || 'h' ELSE CAST((page_id % 500) // 24 AS VARCHAR) || 'd' END AS age,
  printf('%.2f,%.2f,%.2f,%.2f', page_id % 180 - 0.25, page_id % 90 - 0.25, page_id % 180 + 0.25, page_id % 90 + 0.25) AS box, upper(url) = url AS caps FROM pages WHERE page_id % 500 > 0 OR page_id % 48 = 0""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    hours = F.when(k % 48 == 0, 0).otherwise(k % 500).cast("double")
    box = scalar.bounding_box((k % 90).cast("double"), (k % 180).cast("double"), 0.25)
    own = read(spark, sf_dir, "pages").where("page_id % 500 > 0 or page_id % 48 = 0")
    return own.select("page_id", scalar.url_host(F.col("url")).alias("host"), scalar.age_label(hours).alias("age"), box.alias("box"), scalar.all_caps(F.col("url")).alias("caps"))


@query(r"""
WITH x AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'x' || user_id WHEN 2 THEN '' END AS n FROM events)
SELECT event_id, coalesce(TRY_CAST(n AS INTEGER), 0) AS lenient, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') END AS at, strftime(ts, '%Y-%m-%d') AS compact, strftime(ts, '%Y-%m-%dT00:00:00') AS observed FROM x""")
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and dates in the forms that feeds give them in, bad ones among them."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    n = F.when(k % 4 == 0, F.col("user_id").cast("string")).when(k % 4 == 1, F.concat(F.lit("x"), F.col("user_id").cast("string"))).when(k % 4 == 2, "")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 4 == 0, F.concat(iso, F.lit("Z"))).when(k % 4 == 1, iso).when(k % 4 == 2, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))).otherwise("soon")
    added, occurred = F.when(k % 2 == 0, F.date_format("ts", "yyyyMMddHHmmss")).otherwise("none"), F.date_format("ts", "yyyyMMdd")
    return e.select("event_id", scalar.safe_int(n).alias("lenient"), F.date_format(scalar.parse_time(text), "yyyy-MM-dd'T'HH:mm:ss").alias("at"), scalar.compact_date(added, occurred).alias("compact"), scalar.observed_at(added, occurred).alias("observed"))


@query("""
WITH f AS (SELECT event_type, count(*) AS n, avg(value) AS mean, median(value) AS median, min(value) AS least, max(value) AS most, stddev_samp(value) * pow(count(*), -0.2) AS w FROM events WHERE value IS NOT NULL GROUP BY 1),
i AS (SELECT *, unnest(range(0, 50)) AS i FROM f), c AS (SELECT event_type, value AS x, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
d AS (SELECT event_type, i, least + (most - least) * i / 49 AS spot, any_value(n) AS n, any_value(w) AS w, any_value(mean) AS mean, any_value(median) AS median, sum(c * exp(-pow((least + (most - least) * i / 49 - x) / w, 2) / 2)) AS s FROM i JOIN c USING (event_type) GROUP BY 1, 2, 3)
SELECT event_type, i AS point, n, round(mean, 6) AS mean, round(median, 6) AS median, round(spot, 6) AS x, round(s / (n * w * sqrt(2 * pi())), 8) AS density FROM d""")
def value_violins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shape.violins(read(spark, sf_dir, "events"), "event_type", "value", 50)
    rows = out.select("event_type", "n", "mean", "median", F.posexplode("points").alias("point", "p"))
    return rows.select("event_type", F.col("point").cast("long").alias("point"), "n", *(F.round(c, 6).alias(c) for c in ("mean", "median")), F.round("p.x", 6).alias("x"), F.round("p.density", 8).alias("density"))


@query()
def value_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the values of each kind of event, and all of them, are from having one mode."""
    rows = read(spark, sf_dir, "events").select("event_type", "value")
    return shape.dips(rows.unionByName(rows.withColumn("event_type", F.lit("all"))), "event_type", "value")


# Trades ------------------------------------------------------------------------------------------------------------

_THESES_SQL = """
WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN o_custkey % 5 > 0 THEN 'T' || o_custkey % 30 END AS instrument, CASE WHEN o_custkey % 2 = 0 THEN 'short' ELSE 'long' END AS direction, o_totalprice / 300000 AS confidence FROM orders),
r AS (SELECT id FROM t WHERE id % 3 > 0 UNION ALL SELECT -c_custkey - 1 FROM customer),
"""


def _theses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "approved").otherwise("rejected")
    theses = read(spark, sf_dir, "orders").select(k.alias("id"), status.alias("status"), F.when(c % 5 > 0, F.concat(F.lit(" t"), (c % 30).cast("string"))).alias("instrument"), F.when(c % 2 == 0, "short").otherwise("long").alias("direction"), F.col("o_orderpriority").alias("title"), (F.col("o_totalprice") / 300000).alias("confidence"), F.lit(30).alias("horizon_days"))
    unknown = read(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).alias("id"))
    return theses, theses.where("id % 3 > 0").select("id").unionByName(unknown)


@query(_THESES_SQL + """x AS (SELECT r.id, t.status, t.instrument, t.confidence FROM r LEFT JOIN t ON t.id = r.id)
SELECT id, CASE WHEN status IS NULL THEN 'not found' WHEN status = 'pending' THEN 'approved' ELSE 'not pending' END AS outcome, CASE WHEN instrument IS NOT NULL THEN CAST(substr(instrument, 2) AS INTEGER) < 25 END AS ticker_valid, CASE WHEN status = 'pending' THEN round(least(greatest(confidence, 0), 1), 9) END AS probability FROM x""")
def theses_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    theses, asked = _theses(spark, sf_dir)
    tickers = read(spark, sf_dir, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ticker"))
    done = trading.approved(theses, asked, tickers, F.lit("2024-01-01").cast("date"))
    forecasts = done.predictions.select(F.col("thesis_id").alias("id"), F.round("probability", 9).alias("probability"))
    return done.report.join(forecasts, "id", "left")


@query(_THESES_SQL + """p AS (SELECT 'T' || n_nationkey AS ticker, CASE WHEN n_nationkey % 4 > 0 THEN 10.0 + n_nationkey WHEN n_nationkey % 8 = 0 THEN 5.0 END AS price FROM nation),
h AS (SELECT id FROM t WHERE id % 7 = 0), x AS (SELECT r.id, t.status, t.instrument, t.direction, p.price, h.id AS held FROM r LEFT JOIN t ON t.id = r.id LEFT JOIN p ON p.ticker = t.instrument LEFT JOIN h ON h.id = r.id),
o AS (SELECT *, CASE WHEN status IS NULL THEN 'not found' WHEN status <> 'approved' THEN 'not approved' WHEN instrument IS NULL THEN 'no instrument' WHEN held IS NOT NULL THEN 'has an open trade' WHEN price IS NULL THEN 'no price' ELSE 'opened' END AS outcome FROM x)
SELECT id, outcome, CASE WHEN outcome = 'opened' THEN id * 2 END AS trade_id, CASE WHEN outcome = 'opened' THEN round(10000 / price, 6) END AS quantity, CASE WHEN outcome = 'opened' THEN CASE direction WHEN 'short' THEN 'sell' ELSE 'buy' END END AS direction, CASE WHEN outcome = 'opened' AND id % 2 = 0 THEN id * 10 END AS prediction_id FROM o""")
def trades_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices come from one source, for some tickers from a second one; theses of even ids have two forecasts."""
    theses, asked = _theses(spark, sf_dir)
    k, c = F.col("n_nationkey"), F.col
    ticker = F.concat(F.lit("T"), k.cast("string")).alias("ticker")
    nation = read(spark, sf_dir, "nation")
    sources = [nation.select(ticker, F.when(k % 4 > 0, k + 10.0).otherwise(0.0).alias("price")), nation.where(k % 8 == 0).select(ticker, F.lit(5.0).alias("price"))]
    held = theses.where("id % 7 = 0").select(c("id").alias("thesis_id"), F.lit(None).cast("string").alias("closed_at"))
    two = F.explode(F.array(F.lit(0), F.lit(1))).alias("n")
    forecasts = theses.where("id % 2 = 0").select("id", two).select((c("id") * 10 + c("n")).alias("id"), c("id").alias("thesis_id"), F.lit("economic").alias("macro_area"), F.lit(None).cast("long").alias("trade_id"), F.lit(False).alias("resolved"))
    done = trading.opened(theses, asked, held, forecasts, sources, ["T1", "T2", "T3"], F.lit("2024-01-01"))
    agent = done.trades.where("portfolio = 'agent'").select(c("thesis_id").alias("id"), "trade_id", F.round("quantity", 6).alias("quantity"), "direction")
    linked = done.predictions.where("trade_id is not null").select(c("thesis_id").alias("id"), c("id").alias("prediction_id"))
    return done.report.join(agent, "id", "left").join(linked, "id", "left")


@query("""
SELECT n_name AS portfolio, 'T' || l_partkey % 30 AS ticker, l_quantity AS quantity, strftime(l_shipdate, '%Y-%m-%d') AS opened_at FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_linestatus = 'O'""")
def trades_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("name"))
    trades = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("portfolio_id"), F.concat(F.lit("T"), (F.col("l_partkey") % 30).cast("string")).alias("ticker"), F.lit("long").alias("direction"), F.col("l_quantity").alias("quantity"), F.lit(1.0).alias("price_open"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("opened_at"), F.when(F.col("l_linestatus") != "O", "then").alias("closed_at"))
    return trading.open_trades(trades, names).select("portfolio", "ticker", "quantity", "opened_at")


@query("""
SELECT o_custkey AS set_id, o_orderpriority AS scenario, 'item ' || l_linenumber AS label, l_returnflag AS indicator_query, CASE WHEN l_linestatus = 'F' THEN 'triggered' ELSE 'active' END AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def scenarios_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("set_id"), F.col("o_orderpriority").alias("label"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.concat(F.lit("item "), F.col("l_linenumber").cast("string")).alias("label"), F.col("l_returnflag").alias("indicator_query"), F.when(F.col("l_linestatus") == "F", "triggered").otherwise("active").alias("status"), F.lit(None).cast("string").alias("triggered_at"))
    return trading.watched_scenarios(own, items).drop("triggered_at")
