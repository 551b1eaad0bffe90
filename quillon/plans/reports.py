"""More queries over the driver's tables, each with its SQL: alerts, forecasts, theses, checks and briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import alerts, brief, desk, grouping, health, scoring, vectors
from quillon.plans.catalog import _UNNEST_SQL, day, query, read

# Alerts ------------------------------------------------------------------------------------------------------------

_CELLS_SQL = """
WITH cells AS (SELECT event_type AS country, user_id % 4 + 1 AS quad, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS x FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3),
w AS (SELECT *, count(x) OVER p AS n, avg(x) OVER p AS mean, stddev_samp(x) OVER p AS sd FROM cells WINDOW p AS (PARTITION BY country, quad ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (x - mean) / sd AS z, CASE quad WHEN 1 THEN 'verbal cooperation' WHEN 2 THEN 'material cooperation' WHEN 3 THEN 'verbal conflict' ELSE 'material conflict' END AS label FROM w WHERE n >= 10 AND sd > 0 AND x >= -10)
SELECT country || ' ' || label || ' anomaly ' || day AS title, day AS first_seen, country AS location_name, CAST(least(greatest(round_even(abs(z), 0), 1), 5) AS INTEGER) AS severity,
  CASE WHEN z < 0 THEN 'escalation' ELSE 'de-escalation' END AS way FROM z WHERE abs(z) >= 2 AND NOT (country = 'click' AND label = 'verbal conflict')"""


@query(_CELLS_SQL)
def anomaly_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of a mood series, but for titles that exist: here those of one cell of every day."""
    rows = read(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("country"), (F.col("user_id") % 4 + 1).cast("int").alias("quad_class"), day("ts").alias("day"), F.col("value").alias("goldstein"), F.col("value").alias("avg_tone"))
    existing = rows.where("country = 'click'").select(F.concat(F.lit("click verbal conflict anomaly "), "day").alias("title")).distinct()
    found = alerts.mood_events(alerts.mood_series(rows), existing, latest_only=False)
    way = F.regexp_extract("summary", r"— ([a-z-]+)\. Avg tone", 1)
    return found.select("title", "first_seen", "location_name", "severity", way.alias("way"))


# Forecasts ---------------------------------------------------------------------------------------------------------

_AREAS, _KINDS = ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["F", "O"]


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority", "o_orderstatus")
    p, happened = F.col("l_discount") * 10, F.col("l_returnflag") != "R"
    scored = lines.join(orders, "l_orderkey").withColumn("p", p)
    return scored.select(
        F.col("p").alias("probability"), (F.col("l_linestatus") == "F").alias("resolved"), (F.col("l_linenumber") == 1).alias("outcome"), F.when(F.col("l_linenumber") > 2, happened).alias("outcome_eventual"),
        scoring.brier(F.col("p"), happened).alias("brier_score"), F.when(F.col("l_linenumber") != 3, scoring.time_adjusted(F.col("p"), happened, F.to_date("l_shipdate"), F.to_date("o_orderdate"))).alias("time_adjusted_score"),
        F.col("o_orderpriority").alias("macro_area"), F.col("o_orderstatus").alias("prediction_type"))


@query(f"""
WITH p AS (SELECT l_discount * 10 AS p, CASE WHEN l_linenumber > 2 THEN l_returnflag <> 'R' ELSE l_linenumber = 1 END AS happened, (l_discount * 10 - CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) ** 2 AS b,
  CASE WHEN l_linenumber <> 3 THEN CASE WHEN l_returnflag = 'R' THEN 0 ELSE (1 - (l_discount * 10 - 1) ** 2) * greatest(0, 1 - 0.001 * abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))) END END AS t,
  o_orderpriority AS area, o_orderstatus AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'),
f(k, label, lo, hi) AS (VALUES {', '.join(f"({k}, '{name}', {k / 5}, {(k + 1) / 5 if k < 4 else 2})" for k, name in enumerate(desk.BUCKETS))}),
a AS (SELECT 'overall' AS section, 'all' AS label, p.*, NULL::DOUBLE AS h, 1 AS one FROM p UNION ALL SELECT 'area', area, p.*, NULL, 1 FROM p WHERE area IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  UNION ALL SELECT 'type', kind, p.*, NULL, 1 FROM p WHERE kind IN ('F', 'O') UNION ALL SELECT 'bucket', f.label, p.*, CASE WHEN p.p IS NULL THEN NULL WHEN happened THEN 1.0 ELSE 0.0 END, CASE WHEN p.p IS NULL THEN NULL ELSE 1 END FROM f LEFT JOIN p ON p.p >= lo AND p.p < hi AND p.p <= 1)
SELECT section, label, count(one) AS n, round(avg(b), 6) AS mean_brier, round(avg(t), 6) AS mean_time_adjusted, round(avg(h), 6) AS accuracy FROM a GROUP BY 1, 2""")
def calibration_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = desk.calibration_report(_predictions(spark, sf_dir), _AREAS, _KINDS)
    return out.select("section", "label", "n", *(F.round(c, 6).alias(c) for c in ("mean_brier", "mean_time_adjusted", "accuracy")))


@query("""
SELECT o_orderkey AS id, o_orderpriority AS macro_area, strftime(o_orderdate, '%Y-%m-%d') AS horizon_date FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def predictions_by_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("resolved"), F.col("o_orderpriority").alias("macro_area"), F.lit("any").alias("prediction_type"), day("o_orderdate").alias("horizon_date"))
    domains = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prediction_id"), F.col("l_returnflag").alias("domain"))
    return desk.selected_predictions(rows, domains, resolved=True, macro_area="2-HIGH", domain="R").select("id", "macro_area", "horizon_date")


@query("""
SELECT event_id AS id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_seen FROM events
WHERE value > 20 AND user_id % 5 <> 0 AND event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 3000""")
def newest_on_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located events of two types since a day, the newest 3,000 that a map holds."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.lit("any").alias("origin"), F.col("ts").alias("first_seen"), F.when(F.col("value") > 20, F.col("value")).alias("lat"), F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("double")).alias("lon"))
    out = desk.map_events(e, ["click", "error"], [], F.lit("2024-01-10").cast("timestamp"))
    return out.select("id", "event_type", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query(f"""
WITH {_UNNEST_SQL}, c AS (SELECT vec_id % 20 AS event, label, pos, avg(x) AS x FROM x GROUP BY 1, 2, 3), n AS (SELECT event, label, sqrt(sum(x * x)) AS n FROM c GROUP BY 1, 2),
s AS (SELECT a.event, a.label AS block_a, b.label AS block_b, greatest(0, least(1, 1 - sum(a.x * b.x) / any_value(na.n) / any_value(nb.n))) AS score
  FROM c a JOIN c b ON a.event = b.event AND a.pos = b.pos AND a.label < b.label JOIN n na ON na.event = a.event AND na.label = a.label JOIN n nb ON nb.event = b.event AND nb.label = b.label GROUP BY 1, 2, 3)
SELECT block_a || ' ↔ ' || block_b AS pair, round(avg(score), 6) AS mean, count(*) AS n FROM s GROUP BY 1""")
def divergence_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = vectors.divergences(read(spark, sf_dir, "embeddings").withColumn("event", F.col("vec_id") % 20), "event", "label", "embedding")
    return desk.pair_means(scores).select("pair", F.round("mean", 6).alias("mean"), "n")


# Entities and stories ----------------------------------------------------------------------------------------------


@query("""
SELECT c.c_custkey AS id, c.c_mktsegment AS entity_type FROM customer c
WHERE c.c_acctbal > 0 AND EXISTS (SELECT 1 FROM customer a WHERE a.c_custkey >= 40 AND a.c_custkey % 40 = c.c_custkey AND a.c_mktsegment <> c.c_mktsegment)""")
def alias_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("entity_type"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("wikidata_qid"), F.when(F.col("c_custkey") >= 40, F.col("c_custkey") % 40).alias("canonical_entity_id"))
    return desk.alias_conflicts(c).select("id", "entity_type")


@query("SELECT n AS size, count(*) AS stories FROM (SELECT coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_custkey END, o_orderkey + 1000000000) AS root, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def story_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1000000000).alias("id"), F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("story_id"))
    return desk.story_sizes(e).groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("stories"))


@query("""
SELECT d.c_custkey AS id, d.c_name AS title, o.c_custkey AS original_id, o.c_name AS original_title
FROM customer d JOIN customer o ON o.c_custkey = d.c_custkey // 10 WHERE d.c_mktsegment = 'FURNITURE'""")
def duplicates_beside_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_mktsegment") == "FURNITURE", F.expr("c_custkey div 10")).alias("duplicate_of"))
    return desk.with_originals(c)


@query("""
WITH d AS (SELECT o_custkey AS cluster, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title, o_orderdate AS t, o_orderstatus AS origin FROM orders),
s AS (SELECT cluster, arg_min(title, row(t, id)) FILTER (WHERE title <> '') AS title, min(t) AS lo, max(t) AS hi, count(*) AS n FROM d GROUP BY 1),
o AS (SELECT cluster, origin, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(row(t, id))) AS k FROM d GROUP BY 1, 2)
SELECT s.cluster AS event_id, coalesce(title, 'Event ' || s.cluster) AS title, strftime(lo, '%Y-%m-%d') AS first_seen, strftime(hi, '%Y-%m-%d') AS last_seen, origin, n AS n_documents FROM s JOIN o ON o.cluster = s.cluster AND k = 1""")
def clusters_as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, customers as clusters: title, span and origin of each."""
    rows = read(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    docs = rows.select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderdate").alias("published"), F.col("o_orderstatus").alias("origin"))
    events, _ = grouping.cluster_events(docs, rows.select("id", F.col("o_custkey").alias("cluster")), F.lit("2030-01-01").cast("timestamp"))
    return events.withColumn("first_seen", day("first_seen")).withColumn("last_seen", day("last_seen"))


# Scores ------------------------------------------------------------------------------------------------------------


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = F.col, F.col("l_quantity")
    lines = read(spark, sf_dir, "lineitem").where("year(l_shipdate) in (1997, 1998)").groupBy(c("l_suppkey").alias("ticker"), (1998 - F.year("l_shipdate")).alias("period_rank"))
    of = lambda x: F.sum(x).cast("double")
    items = {
        "Total Assets": of(q), "Net Income": of(F.when(c("l_linenumber") == 1, q)), "Operating Cash Flow": of(F.when(c("l_linenumber") == 2, q)), "Long Term Debt": of(F.when(c("l_returnflag") == "R", q)),
        "Total Current Assets": of(F.when(c("l_returnflag") == "N", q)), "Current Liabilities": of(F.when(c("l_returnflag") == "A", q)), "Share Issued": F.count(F.lit(1)).cast("double"),
        "Operating Revenue": of(F.when(c("l_linestatus") == "O", q)), "Gross Profit": of(F.when(c("l_linenumber") > 6, q)),
    }
    wide = lines.agg(*(x.alias(n) for n, x in items.items()))
    return wide.select("ticker", "period_rank", F.explode(F.array(*(F.struct(F.lit(n).alias("item"), c(n).alias("value")) for n in items))).alias("i")).select("ticker", "period_rank", "i.*").where("value is not null")


@query("""
WITH y AS (SELECT l_suppkey AS k, 1998 - year(l_shipdate) AS p, sum(l_quantity) AS ta, sum(l_quantity) FILTER (WHERE l_linenumber = 1) AS ni, sum(l_quantity) FILTER (WHERE l_linenumber = 2) AS oc, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS de,
  sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS ca, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS cl, count(*) AS sh, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS re, sum(l_quantity) FILTER (WHERE l_linenumber > 6) AS gp
  FROM lineitem WHERE year(l_shipdate) IN (1997, 1998) GROUP BY 1, 2),
t AS (SELECT coalesce(a.k, b.k) AS k, [a.ni / nullif(a.ta, 0) > 0, a.oc > 0, a.ni / nullif(a.ta, 0) > b.ni / nullif(b.ta, 0), a.oc > a.ni, a.de / nullif(a.ta, 0) <= b.de / nullif(b.ta, 0), a.ca / nullif(a.cl, 0) > b.ca / nullif(b.cl, 0), a.sh <= b.sh,
  a.gp / nullif(a.re, 0) > b.gp / nullif(b.re, 0), a.re / nullif(a.ta, 0) > b.re / nullif(b.ta, 0)] AS t FROM (SELECT * FROM y WHERE p = 0) a FULL JOIN (SELECT * FROM y WHERE p = 1) b ON a.k = b.k),
c AS (SELECT k, len(list_filter(t, lambda x: x IS NOT NULL)) AS n, len(list_filter(t, lambda x: coalesce(x, false))) AS s FROM t)
SELECT k AS ticker, CASE WHEN n > 0 THEN CAST(s AS INTEGER) END AS score, CAST(n AS INTEGER) AS testable FROM c""")
def piotroski_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tests of statements of two years, one supplier a company."""
    score, n = scoring.piotroski()
    return scoring.statement_items(_statements(spark, sf_dir), scoring.ITEMS).select("ticker", score.alias("score"), n.alias("testable"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(0.01, round_even(p, 4)) AS probability FROM s""")
def probability_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of an order's lines by the library's own rule."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return scoring.normalised_probabilities(lines, "l_orderkey", F.col("l_extendedprice")).drop("l_extendedprice")


@query("""
WITH c AS (SELECT c_nationkey AS k, sum(c_acctbal) AS ta, max(c_acctbal) AS re, sum(c_acctbal) FILTER (WHERE c_acctbal > 5000) AS big, count(*) * 1000.0 AS cap FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, sum(s_acctbal) AS wc FROM supplier GROUP BY 1),
z AS (SELECT n_name AS company, 1.2 * wc / nullif(ta, 0) + 1.4 * re / nullif(ta, 0) + 3.3 * big / nullif(ta, 0) + 0.6 * cap / nullif(wc, 0) + big / nullif(ta, 0) AS z FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey)
SELECT company, round_even(z, 2) AS z, CASE WHEN z IS NULL THEN 'unavailable' WHEN z > 2.99 THEN 'safe' WHEN z < 1.81 THEN 'distress' ELSE 'grey' END AS zone FROM z""")
def altman_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and zone of nations as companies, by the library's own rule."""
    c, none = F.col, F.lit(None).cast("double")
    own = read(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("total_assets_0"), F.max("c_acctbal").alias("retained_0"), F.sum(F.when(c("c_acctbal") > 5000, c("c_acctbal"))).alias("ebit_0"), (F.count(F.lit(1)) * 1000.0).alias("cap"))
    capital = read(spark, sf_dir, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("working_capital_0"))
    rows = read(spark, sf_dir, "nation").join(own, "n_nationkey", "left").join(capital, "n_nationkey", "left")
    rows = rows.withColumns({"total_liabilities_0": c("working_capital_0"), "revenue_0": c("ebit_0"), "current_assets_0": none, "current_liabilities_0": none})
    z, zone = scoring.altman(c("cap"), F.lit(False))
    return rows.select(c("n_name").alias("company"), z.alias("z"), zone.alias("zone"))


# Theses ------------------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT l_orderkey AS id, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE 'pending' END AS s FROM lineitem)
SELECT o_orderkey AS id, coalesce((SELECT arg_min(s, row(seq, s)) FROM r WHERE r.id = o_orderkey AND s <> 'pending'), 'pending') AS status FROM orders""")
def thesis_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as theses, their lines as requests: the first approval or rejection counts."""
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"))
    flag = F.col("l_returnflag")
    asked = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber"), F.when(flag == "A", 0).otherwise(1)).alias("seq"), F.when(flag == "R", "rejected").when(flag == "A", "approved").otherwise("pending").alias("status"))
    return desk.changed(items, asked, desk.CHANGES["thesis"])


@query("""
WITH t AS (SELECT p_partkey AS k, p_name, p_brand, p_size, p_retailprice / 2000 AS conf FROM part)
SELECT k AS answer_id, CAST(0 AS INTEGER) AS alternative, p_name AS title, p_brand AS instrument, p_size AS horizon_days, CASE WHEN p_size % 7 = 0 THEN NULL ELSE round(conf, 6) END AS confidence, CASE WHEN p_size % 7 <> 0 AND conf >= 0.6 THEN true ELSE false END AS opened FROM t
UNION ALL SELECT k, 1, 'Not ' || p_name, p_brand, NULL, NULL, false FROM t WHERE p_size % 2 = 0""")
def proposed_theses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in fenced JSON, read as theses and their alternatives, and those that open by themselves."""
    p = F.col("p_size")
    alternative = F.when(p % 2 == 0, F.array(F.struct(F.concat(F.lit("Not "), "p_name").alias("title"), F.col("p_brand").alias("instrument"))))
    confidence = F.when(p % 7 == 0, "high").otherwise((F.col("p_retailprice") / 2000).cast("string"))
    listed = F.to_json(F.array(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("instrument"), p.alias("horizon_days"), confidence.alias("confidence"), alternative.alias("alternatives"))))
    found = desk.proposals(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("answer_id"), F.concat(F.lit("Sure:\n```json\n"), listed, F.lit("\n```")).alias("text")))
    opened = desk.auto_opened(found).select("answer_id", "alternative", F.lit(True).alias("opened"))
    out = found.join(opened, ["answer_id", "alternative"], "left")
    return out.select("answer_id", "alternative", "title", "instrument", "horizon_days", F.round("confidence", 6).alias("confidence"), F.coalesce("opened", F.lit(False)).alias("opened"))


# Checks and briefs -------------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT event_type, (epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 3600 AS h FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), n AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'),
o AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS n, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01') AS late FROM orders)
SELECT 'freshness' AS section, event_type || 's' AS name, CASE WHEN h <= CASE event_type WHEN 'click' THEN 72 ELSE 2 END THEN 'ok' ELSE 'warn' END AS status FROM a UNION ALL SELECT 'freshness', 'none', 'skip'
UNION ALL SELECT 'backlog', 'pending', CASE WHEN n >= 500 THEN 'warn' ELSE 'ok' END FROM n UNION ALL SELECT 'state', 'open', CASE WHEN late > 0 THEN 'warn' ELSE 'ok' END FROM o""")
def health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, orders, c = read(spark, sf_dir, "events"), read(spark, sf_dir, "orders"), F.col
    out = health.checks(
        spark, F.lit("2024-02-01"),
        [health.Fresh("clicks", events.where("event_type = 'click'"), "ts", 72), health.Fresh("views", events.where("event_type = 'view'"), "ts", 2), health.Fresh("none", None, "ts", 2)],
        [health.Backlog("pending", orders, c("o_orderstatus") == "P", 500)],
        [health.Overdue("open", orders, c("o_orderstatus") == "O", c("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))],
    )
    return out.select("section", "name", "status")


_BRIEF_SQL = """
WITH e AS (SELECT o_orderkey AS event_id, o_orderdate AS last_seen, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS severity, CASE o_orderstatus WHEN 'F' THEN 'rss' WHEN 'O' THEN 'usgs' ELSE 'other' END AS origin FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
d AS (SELECT l_orderkey AS event_id, l_discount * 10 AS score, l_linenumber AS block_a, l_partkey AS block_b, l_suppkey FROM lineitem WHERE l_discount * 10 > 0.5),
n AS (SELECT l_orderkey AS event_id, count(*) AS n FROM lineitem GROUP BY 1),
a AS (SELECT event_id FROM d JOIN e USING (event_id) ORDER BY score DESC, last_seen DESC, event_id, block_a, block_b LIMIT 8),
r AS (SELECT event_id FROM e JOIN n USING (event_id) WHERE origin = 'rss' ORDER BY n DESC, last_seen DESC, event_id LIMIT 12),
s AS (SELECT event_id FROM e WHERE origin = 'usgs' ORDER BY severity DESC, last_seen DESC, event_id LIMIT 12),
g AS (SELECT n_regionkey AS x, n_nationkey AS y FROM nation), u AS (SELECT x AS id, count(*) AS degree FROM (SELECT x FROM g UNION ALL SELECT y FROM g) GROUP BY 1 ORDER BY degree DESC, id LIMIT 10)
SELECT 'divergences' AS list, event_id AS id, count(*) AS n FROM a GROUP BY 1, 2 UNION ALL SELECT 'recent', event_id, 1 FROM r UNION ALL SELECT 'anomalies', event_id, 1 FROM s
UNION ALL SELECT 'hubs', id, degree FROM u UNION ALL SELECT 'events', NULL, count(DISTINCT event_id) FROM (SELECT * FROM a UNION ALL SELECT * FROM r UNION ALL SELECT * FROM s)"""


@query(_BRIEF_SQL)
def brief_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a brief's lists hold, and how many events they name."""
    orders, lines, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), F.col
    origin = F.when(c("o_orderstatus") == "F", "rss").when(c("o_orderstatus") == "O", "usgs").otherwise("other")
    events = orders.select(c("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("x").alias("event_type"), origin.alias("origin"), F.substring("o_orderpriority", 1, 1).cast("int").alias("severity"), F.lit("y").alias("location_name"), c("o_orderdate").alias("last_seen"), F.lit("z").alias("summary"))
    apart = lines.select(c("l_orderkey").alias("event_id"), c("l_linenumber").alias("block_a"), c("l_partkey").alias("block_b"), (c("l_discount") * 10).alias("divergence_score"))
    nation = read(spark, sf_dir, "nation")
    names = nation.select(c("n_nationkey").cast("long").alias("id"), c("n_name").alias("name"))
    links = nation.select(c("n_regionkey").cast("long").alias("entity_a"), c("n_nationkey").cast("long").alias("entity_b"))
    sets = spark.createDataFrame([], "id long, country_name string, horizon_date string, status string")
    scenarios = spark.createDataFrame([], "set_id long, label string, title string, probability double")
    found = brief.context(events, lines.select(c("l_orderkey").alias("event_id"), c("l_partkey").alias("document_id")), apart, names, links, sets, scenarios, F.lit("1996-01-01").cast("timestamp"))
    one = lambda name, df: df.select(F.lit(name).alias("list"), c("event_id").alias("id"), F.lit(1).cast("long").alias("n"))
    out = found.divergences.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("divergences").alias("list"), c("event_id").alias("id"), "n")
    out = out.unionByName(one("recent", found.recent)).unionByName(one("anomalies", found.anomalies)).unionByName(found.hubs.select(F.lit("hubs").alias("list"), "id", c("degree").alias("n")))
    return out.unionByName(found.n_events().select(F.lit("events").alias("list"), F.lit(None).cast("long").alias("id"), c("n_events").alias("n")))
