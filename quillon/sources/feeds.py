"""Readers of the feeds, each a projection to typed columns. A reader takes the path of landed files, or fetched pages
(a DataFrame with ``content``, one document a row; ``quillon.sources.fetched`` gives such).

``EVENT`` is the common shape of events from all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.lookups import lookup
from quillon.functions.scalar import compact_date, content_hash, epoch_ms, joined_key, number, parse_time, safe_float, safe_int, severity_deaths, severity_goldstein, severity_magnitude, strip_tags, title_country, wkt_point
from quillon.operators.relational import first_wins

EVENT = "title string, summary string, first_seen string, last_seen string, event_type string, origin string, severity int, location_name string, lat double, lon double"

_ACTOR = ["Code", "Name", "CountryCode", "KnownGroupCode", "EthnicCode", "Religion1Code", "Religion2Code", "Type1Code", "Type2Code", "Type3Code"]
_PLACE = ["Type", "FullName", "CountryCode", "ADM1Code", "ADM2Code", "Lat", "Long", "FeatureID"]
#: Columns of the 61-column event export.
EVENT_COLUMNS = [
    *["GlobalEventID", "SQLDATE", "MonthYear", "Year", "FractionDate"],
    *(f"Actor{i}{c}" for i in (1, 2) for c in _ACTOR),
    *["IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass", "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone"],
    *(f"{who}Geo_{c}" for who in ("Actor1", "Actor2", "Action") for c in _PLACE),
    *["DATEADDED", "SOURCEURL"],
]
#: Names of the twenty root codes of the event code book.
EVENT_TYPES = {"01": "statement", "02": "appeal", "03": "cooperate_intent", "04": "consult", "05": "diplomatic", "06": "material_coop", "07": "aid", "08": "yield", "09": "investigate", "10": "demand", "11": "disapprove", "12": "reject", "13": "threaten", "14": "protest", "15": "force_posture", "16": "reduce_relations", "17": "coerce", "18": "assault", "19": "fight", "20": "mass_violence"}
#: Kinds of violence, directions of trade, and short names of the commodities that are watched.
VIOLENCE = {"1": "state-based conflict", "2": "non-state conflict", "3": "one-sided violence"}
FLOWS = {"M": "Import", "X": "Export"}
COMMODITIES = {"8541": "semiconductor devices", "8542": "integrated circuits", "8486": "chip-making machinery"}


Source = str | DataFrame
#: Rows of one batch of a zip's member.
ZIP_ROWS = 20_000


def _json(spark: SparkSession, source: Source, schema: str) -> DataFrame:
    """JSON documents, one a file or one a page."""
    if isinstance(source, str):
        return spark.read.schema(schema).json(source, multiLine=True)
    return source.where("content is not null").select(F.from_json("content", schema).alias("j")).select("j.*")


def zipped_rows(spark: SparkSession, path: str, columns: list[str], header: bool = False, delimiter: str = ",") -> DataFrame:
    """Rows of all members of zip files, columns as text, empty values as null. With a header, columns go by name and
    values may be quoted and hold line breaks; without one they go by place and quotes are plain characters.

    A member is read as a stream: a task holds a compressed file and one batch of rows.
    """
    limit = ZIP_ROWS

    def run(parts: Iterator) -> Iterator:
        import csv
        import io
        import itertools
        import zipfile

        import pandas as pd

        csv.field_size_limit(2**31 - 1)
        n = len(columns)

        def rows(member: io.BufferedIOBase) -> Iterator[list]:
            if header:
                for row in csv.DictReader(io.TextIOWrapper(member, "utf-8-sig", "replace", newline=""), delimiter=delimiter):
                    yield [row.get(c) or None for c in columns]
            else:
                for line in io.TextIOWrapper(member, "utf-8", "replace", newline="\n"):
                    if line.strip():
                        row = [x or None for x in line.rstrip("\r\n").split(delimiter)]
                        yield (row + [None] * n)[:n]

        for pdf in parts:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as member:
                            found = rows(member)
                            while batch := list(itertools.islice(found, limit)):
                                yield pd.DataFrame(batch, columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def file_slots(spark: SparkSession, first: str, last: str, sample_hours: int = 0) -> DataFrame:
    """Names of the 15-minute export files from the first to the last day; with sampling, one in so many hours."""
    step = F.sequence(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)) + F.expr("interval 23 hours 45 minutes"), F.expr("interval 15 minutes"))
    slots = spark.range(1).select(F.explode(step).alias("slot"))
    if sample_hours:
        slots = slots.where((F.minute("slot") == 0) & (F.hour("slot") % sample_hours == 0))
    return slots.select("slot", F.concat(F.date_format("slot", "yyyyMMddHHmmss"), F.lit(".export.CSV.zip")).alias("filename"))


def event_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of plain or gzipped tab-separated exports, all columns as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in EVENT_COLUMNS])
    return spark.read.schema(schema).csv(path, sep="\t", header=False, quote="", escape="", mode="PERMISSIVE")


def event_export_zips(spark: SparkSession, path: str) -> DataFrame:
    """Rows of zipped exports. A zip file is one unit of work; it holds 15 minutes of events."""
    return zipped_rows(spark, path, EVENT_COLUMNS, delimiter="\t")


def filtered_export(rows: DataFrame, quads: list[int], least_mentions: int, most_goldstein: float | None = None, countries: list[str] | None = None) -> DataFrame:
    """Rows of some classes with enough mentions, optionally below a score and about some countries."""
    keep = safe_int(F.col("QuadClass")).isin(quads) & (safe_int(F.col("NumMentions")) >= least_mentions)
    if most_goldstein is not None:
        keep = keep & (safe_float(F.col("GoldsteinScale")) <= most_goldstein)
    if countries:
        own = F.array("Actor1CountryCode", "Actor2CountryCode", "ActionGeo_CountryCode")
        keep = keep & F.arrays_overlap(own, F.array(*(F.lit(c) for c in countries)))
    return rows.where(keep)


def stored_export(rows: DataFrame, order: str, existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """documents, events, event_documents (url, title) and details of export rows, first wins on each key in ``order``.

    Rows without a url are passed over; an event is one for each key of actors, root code, date and place, with what
    its first row says; details need a number above zero. What ``existing`` tables of these names have already, whatever
    its origin, does not come again; rows about a known event or document are linked with it.
    """
    c = F.col
    rows = rows.withColumn("url", F.trim("SOURCEURL")).where("url <> ''")
    key = joined_key(c("Actor1CountryCode"), c("Actor2CountryCode"), c("EventRootCode"), c("SQLDATE"), c("ActionGeo_CountryCode"))
    rows = rows.withColumn("key", key).withColumn("day", compact_date(c("DATEADDED"), c("SQLDATE")))
    title = F.concat(F.lit("GDELT: "), F.coalesce("Actor1Name", F.lit("")), F.lit(" → "), F.coalesce("Actor2Name", F.lit("")), F.lit(" ["), F.coalesce("EventCode", F.lit("")), F.lit("]"))
    documents = first_wins(rows, ["url"], [order]).select(F.lit("gdelt").alias("origin"), "url", title.alias("title"), c("day").alias("published_at"), content_hash(c("url")).alias("content_hash"))
    g = safe_float(c("GoldsteinScale"))
    events = first_wins(rows, ["key"], [order]).select(
        c("key").alias("title"),
        c("day").alias("first_seen"),
        c("day").alias("last_seen"),
        lookup(EVENT_TYPES, F.coalesce("EventRootCode", F.lit("")), F.lit("other")).alias("event_type"),
        F.lit("gdelt").alias("origin"),
        severity_goldstein(g).alias("severity"),
        F.nullif("ActionGeo_FullName", F.lit("")).alias("location_name"),
        F.when(c("ActionGeo_Lat") != "", safe_float(c("ActionGeo_Lat"))).alias("lat"),
        F.when(c("ActionGeo_Long") != "", safe_float(c("ActionGeo_Long"))).alias("lon"),
    )
    ids = rows.withColumn("global_event_id", c("GlobalEventID").try_cast("long")).where("global_event_id > 0")
    details = first_wins(ids, ["global_event_id"], [order]).select(
        "global_event_id", c("key").alias("event_title"), c("SQLDATE").alias("sqldate"), c("day").alias("date_added"), safe_int(c("QuadClass")).alias("quad_class"), g.alias("goldstein"),
        safe_float(c("AvgTone")).alias("avg_tone"), *(safe_int(c(x)).alias(y) for x, y in (("NumMentions", "num_mentions"), ("NumSources", "num_sources"), ("NumArticles", "num_articles"))),
        F.nullif("ActionGeo_CountryCode", F.lit("")).alias("action_geo_country"),
    )
    out = {"documents": documents, "events": events, "event_documents": rows.select("url", c("key").alias("event_title")).distinct(), "details": details}
    keys = {"documents": ["url"], "events": ["title"], "event_documents": ["url", "event_title"], "details": ["global_event_id"]}
    return out | {name: out[name].join(known.select(keys[name]), keys[name], "left_anti") for name, known in (existing or {}).items()}


def _article_rows(spark: SparkSession, source: Source) -> DataFrame:
    def run(parts: Iterator) -> Iterator:
        import xml.etree.ElementTree as ET

        import pandas as pd

        def tag(e: ET.Element) -> str:
            return e.tag.rpartition("}")[2].lower()

        for pdf in parts:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    root = ET.fromstring(content)
                except ET.ParseError as e:
                    out.append((name, None, None, None, None, str(e)))
                    continue
                for item in root.iter():
                    if tag(item) not in ("item", "entry"):
                        continue
                    got = {}
                    for e in item:
                        text = (e.text or "").strip() or e.get("href", "")
                        got.setdefault(tag(e), text)
                    bodies = [got.get(k, "") for k in ("encoded", "content", "summary", "description")]
                    when = next((got[k] for k in ("pubdate", "published", "updated", "date") if got.get(k)), None)
                    out.append((name, got.get("link") or None, got.get("title") or None, next((b for b in bodies if b), None), when, None))
            yield pd.DataFrame(out, columns=["file", "url", "title", "body", "published", "error"])

    if isinstance(source, str):
        files = spark.read.format("binaryFile").load(source).select("path", "content")
    else:
        files = source.where("content is not null").select(F.concat_ws("#", "request", "page").alias("path"), "content")
    return files.mapInPandas(run, "file string, url string, title string, body string, published string, error string")


def articles(spark: SparkSession, source: Source) -> DataFrame:
    """Items of RSS or Atom documents: file, url, title, body, published. One document is one unit of work; those that do
    not parse are told by ``unreadable_articles``."""
    found = _article_rows(spark, source).where("error is null").drop("error")
    return found.withColumn("published_at", parse_time(F.col("published"))).withColumn("content_hash", content_hash(F.coalesce("body", F.lit(""))))


def unreadable_articles(spark: SparkSession, source: Source) -> DataFrame:
    """file, error of the documents that do not parse."""
    return _article_rows(spark, source).where("error is not null").select("file", "error")


def recent(articles: DataFrame, cutoff: Column) -> DataFrame:
    """Articles not older than a cutoff; those without a readable date stay."""
    return articles.where(F.col("published_at").isNull() | (F.col("published_at") >= cutoff))


def chokepoints(spark: SparkSession, source: Source) -> DataFrame:
    """Daily ship counts from landed feature pages."""
    names = ["n_total", "n_tanker", "n_container", "n_dry_bulk", "n_cargo"]
    attributes = "struct<portid:string,portname:string,date:string," + ",".join(f"{n}:int" for n in names) + ",capacity:double>"
    pages = _json(spark, source, f"features array<struct<attributes:{attributes}>>")
    rows = pages.select(F.explode("features.attributes").alias("a")).select("a.*")
    day = F.coalesce(F.to_date(epoch_ms(F.col("date"))), F.to_date(parse_time(F.col("date"))))
    return rows.withColumn("date", day).where(F.col("portid").isNotNull() & F.col("date").isNotNull())


def periods(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Months YYYYMM between two, in order even if the bounds are swapped."""
    a, b = (F.to_date(F.lit(x), "yyyyMM") for x in sorted((first, last)))
    return spark.range(1).select(F.explode(F.sequence(a, b, F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyyMM").alias("period"))


def recent_periods(spark: SparkSession, today: str, n: int = 3, lag: int = 2) -> DataFrame:
    """The last ``n`` months YYYYMM that are published ``lag`` months after they end, the newest first."""
    month = F.trunc(F.to_date(F.lit(today)), "month")
    return spark.range(n).select(F.date_format(F.add_months(month, -F.col("id").cast("int") - lag), "yyyyMM").alias("period")).orderBy(F.col("period").desc())


def trade_flows(spark: SparkSession, source: Source) -> DataFrame:
    record = "reporterCode int, reporterISO string, reporterDesc string, flowCode string, flowDesc string, partnerDesc string, cmdCode string, cmdDesc string, period string, refYear int, refMonth int, primaryValue double, netWgt double"
    pages = _json(spark, source, "data array<struct<" + record.replace(", ", ",").replace(" ", ":") + ">>")
    return pages.select(F.explode("data").alias("d")).select("d.*")


def _grouped(x: Column, digits: int) -> Column:
    """A number with commas between thousands, rounded by its exact binary value; true halves as the even number."""
    return F.format_number(x, digits)


def trade_documents(flows: DataFrame) -> DataFrame:
    """A document for each flow: url, title, body, published_at, content_hash over url and value."""
    c = F.col
    value = F.coalesce("primaryValue", F.lit(0.0))
    label = lookup(FLOWS, c("flowCode"), c("flowCode"))
    who = F.coalesce("reporterISO", c("reporterCode").cast("string"), F.lit("?"))
    short = lookup(COMMODITIES, c("cmdCode"), c("cmdCode"))
    url = F.concat(F.lit("comtrade://"), F.concat_ws("/", who, "cmdCode", "flowCode", "period"))
    title = F.concat(who, F.lit(" "), label, F.lit(" HS"), c("cmdCode"), F.lit(" ("), short, F.lit(") "), c("period"), F.lit(": $"), _grouped(value / 1e6, 1), F.lit("M"))
    body = F.concat(F.coalesce("reporterDesc", who), F.lit(" "), F.lower(label), F.lit(" of HS "), c("cmdCode"), F.lit(" — "), F.coalesce("cmdDesc", short), F.lit(". Partner: "), F.coalesce("partnerDesc", F.lit("World")), F.lit(". Period "), c("period"), F.lit(". Trade value: $"), _grouped(value, 0), F.lit("."))
    body = F.concat(body, F.when(c("netWgt") > 0, F.concat(F.lit(" Net weight: "), _grouped(c("netWgt"), 0), F.lit(" kg."))).otherwise(""))
    published = F.date_format(F.make_date("refYear", "refMonth", F.lit(1)), "yyyy-MM-dd'T'00:00:00")
    return flows.select(url.alias("url"), title.alias("title"), body.alias("body"), published.alias("published_at"), content_hash(url, value.cast("string")).alias("content_hash"))


def _events(df: DataFrame, kind: str, origin: str, severity: Column, title: Column, summary: Column, first: Column, last: Column, place: Column, lat: Column, lon: Column) -> DataFrame:
    return df.select(title.alias("title"), summary.alias("summary"), first.alias("first_seen"), last.alias("last_seen"), F.lit(kind).alias("event_type"), F.lit(origin).alias("origin"), severity.cast("int").alias("severity"), place.alias("location_name"), lat.alias("lat"), lon.alias("lon"))


def earthquakes(spark: SparkSession, source: Source) -> DataFrame:
    feature = "struct<properties:struct<mag:double,place:string,time:bigint>,geometry:struct<coordinates:array<double>>>"
    f = _json(spark, source, f"features array<{feature}>").select(F.explode("features").alias("f"))
    mag, at = F.col("f.properties.mag"), F.date_format(F.timestamp_millis("f.properties.time"), "yyyy-MM-dd'T'HH:mm:ss")
    place = F.coalesce("f.properties.place", F.lit("unknown location"))
    xyz = [F.get("f.geometry.coordinates", F.lit(i)) for i in range(3)]
    title = F.concat(F.lit("M"), F.format_number(mag, 1), F.lit(" earthquake — "), place)
    summary = F.concat(F.lit("Magnitude "), mag.cast("string"), F.lit(" earthquake, "), place, F.lit(", at "), at, F.lit(" UTC"), F.coalesce(F.concat(F.lit(", depth "), xyz[2].cast("string"), F.lit(" km.")), F.lit(".")))
    own = f.where(mag.isNotNull() & at.isNotNull())
    return _events(own, "hazard", "usgs", severity_magnitude(mag), title, summary, at, at, place, xyz[1], xyz[0])


def request_windows(spark: SparkSession, first: str, last: str, days: int = 5) -> DataFrame:
    """Spans of so many days: start and number of days, the last one cut at the end."""
    a, b = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    starts = spark.range(1).select(F.explode(F.sequence(a, b, F.expr(f"interval {days} days"))).alias("start"))
    return starts.withColumn("days", F.least(F.lit(days), F.datediff(b, "start") + 1))


def fire_metrics(spark: SparkSession, path: str, area: Column) -> DataFrame:
    """Detections of each area and day: count, radiative power, centre. Rows without a date are dropped."""
    rows = spark.read.csv(path, header=True).withColumn("area", area).where(F.trim("acq_date") != "")
    frp = number(F.col("frp"))
    return rows.groupBy("area", F.to_date("acq_date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(frp), F.lit(0.0)).alias("frp_sum"), F.max(frp).alias("frp_max"), F.avg(number(F.col("latitude"))).alias("lat"), F.avg(number(F.col("longitude"))).alias("lon"))


def outage_signals(spark: SparkSession, source: Source) -> DataFrame:
    """country, datasource, from, step, values of signal responses in any of their three shapes."""
    sig = "struct<entityCode:string,datasource:string,`from`:bigint,until:bigint,step:bigint,nativeStep:bigint,`values`:array<double>>"
    raw = spark.read.text(source, wholetext=True).select("value") if isinstance(source, str) else source.select(F.col("content").alias("value"))
    data = F.get_json_object("value", "$.data")
    shapes = F.coalesce(
        F.when(F.startswith(data, F.lit("{")), F.from_json(F.get_json_object("value", "$.data.signals"), f"array<{sig}>")),
        F.when(data.rlike(r"^\[\s*\["), F.flatten(F.from_json(data, f"array<array<{sig}>>"))),
        F.when(F.startswith(data, F.lit("[")), F.from_json(data, f"array<{sig}>")),
    )
    one = raw.select(F.explode(shapes).alias("s")).select("s.*")
    return one.select(F.col("entityCode").alias("country"), "datasource", "from", F.coalesce("step", "nativeStep", F.lit(300)).alias("step"), "values")


#: Columns of the conflict file that are read.
CONFLICT_COLUMNS = ["id", "conflict_name", "type_of_violence", "side_a", "side_b", "where_description", "adm_1", "country", "region", "latitude", "longitude", "date_start", "date_end", "best", "deaths_civilians"]


def conflicts(spark: SparkSession, path: str, least_deaths: int = 25, start: str | None = None, end: str | None = None) -> DataFrame:
    """Conflict events of plain or zipped (``*.zip``) files with so many deaths at least, in a span of first days."""
    rows = zipped_rows(spark, path, CONFLICT_COLUMNS, header=True) if path.endswith(".zip") else spark.read.csv(path, header=True, multiLine=True, escape='"')
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    day = lambda c: F.nullif(F.substring(c, 1, 10), F.lit(""))
    rows = rows.withColumn("deaths", F.when(F.coalesce("best", F.lit("")) == "", 0).otherwise(F.col("best").try_cast("int"))).withColumn("d0", day("date_start")).withColumn("d1", F.coalesce(day("date_end"), day("date_start")))
    keep = (F.col("deaths") >= least_deaths) & F.col("d0").isNotNull()
    keep = keep & (F.col("d0") >= start) if start else keep
    keep = keep & (F.col("d0") <= end) if end else keep
    where = F.coalesce(F.nullif(t("where_description"), F.lit("")), F.nullif(t("adm_1"), F.lit("")), t("country"))
    kind = lookup(VIOLENCE, t("type_of_violence"), F.lit("violence"))
    span = F.when(F.col("d0") == F.col("d1"), F.concat(F.lit("on "), "d0")).otherwise(F.concat("d0", F.lit(" to "), "d1"))
    side = lambda c: F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?")))
    civilians = F.coalesce(F.nullif(F.col("deaths_civilians"), F.lit("")), F.lit("0"))
    head = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 99), F.lit(": "), side("side_a"), F.lit(" vs "), side("side_b"))
    place = F.concat(where, F.lit(", "), t("country"))
    toll = F.concat(F.col("deaths").cast("string"), F.lit(" deaths (best estimate, "), civilians, F.lit(" civilians)"))
    summary = F.concat(head, F.lit(", "), place, F.lit(" ("), F.coalesce("region", F.lit("")), F.lit("), "), span, F.lit(". "), toll, F.lit(". UCDP GED id "), F.coalesce("id", F.lit("")), F.lit("."))
    title = F.concat(t("conflict_name"), F.lit(" — "), where)
    return _events(rows.where(keep), "conflict", "ucdp", severity_deaths(F.col("deaths")), title, summary, F.col("d0"), F.col("d1"), place, F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double"))


def outbreaks(spark: SparkSession, source: Source, start: str | None = None, end: str | None = None, most: int = 2000) -> DataFrame:
    rows = _json(spark, source, "value array<struct<DonId:string,UrlName:string,Title:string,PublicationDateAndTime:string,Summary:string,Overview:string>>").select(F.explode("value").alias("v")).select("v.*")
    day, title = F.substring("PublicationDateAndTime", 1, 10), F.trim("Title")
    keep = (day != "") & (title != "")
    keep = keep & (day >= start) if start else keep
    keep = keep & (day <= end) if end else keep
    body = F.substring(strip_tags(F.coalesce("Summary", "Overview", F.lit("")), spaced=True), 1, most)
    summary = F.trim(F.concat(body, F.lit(" [WHO Disease Outbreak News "), F.coalesce("DonId", "UrlName", F.lit("")), F.lit("]")))
    none = F.lit(None).cast("double")
    return _events(rows.where(keep), "epidemic", "who_don", F.lit(2), title, summary, day, day, title_country(title), none, none)


def disasters(spark: SparkSession, source: Source, most: int = 2000) -> DataFrame:
    fields = "struct<name:string,description:string,date:struct<event:string,created:string>,primary_country:struct<name:string,location:struct<lat:double,lon:double>>,primary_type:struct<name:string>>"
    rows = _json(spark, source, f"data array<struct<fields:{fields}>>").select(F.explode("data.fields").alias("f")).select("f.*")
    title, day = F.trim("name"), F.substring(F.coalesce("date.event", "date.created"), 1, 10)
    kind, text = F.coalesce("primary_type.name", F.lit("disaster")), F.substring(F.trim(F.coalesce("description", F.lit(""))), 1, most)
    country = F.col("primary_country.name")
    summary = F.concat(kind, F.when(text != "", F.concat(F.lit(": "), text)).otherwise(F.concat(F.lit(" — "), F.coalesce(country, F.lit("")), F.lit(", "), day, F.lit("."))), F.lit(" [ReliefWeb]"))
    return _events(rows.where((title != "") & (day != "")), "hazard", "reliefweb", F.lit(3), title, summary, day, day, country, F.col("primary_country.location.lat"), F.col("primary_country.location.lon"))


def crises(spark: SparkSession, source: Source) -> DataFrame:
    """One row for each item of query bindings: first date, countries in order of first appearance, first coordinate."""
    names = ["item", "itemLabel", "itemDescription", "start", "pit", "countryLabel", "coord"]
    binding = "struct<" + ",".join(f"{n}:struct<value:string>" for n in names) + ">"
    rows = _json(spark, source, f"results struct<bindings:array<{binding}>>").select(F.posexplode("results.bindings").alias("seq", "b"))
    rows = rows.select("seq", *(F.col(f"b.{n}.value").alias(n) for n in names)).withColumn("qid", F.substring_index("item", "/", -1)).where("itemLabel is not null and itemLabel <> qid")
    lat, lon = wkt_point(F.col("coord"))
    rows = rows.withColumn("day", F.substring(F.coalesce("start", "pit"), 1, 10)).withColumn("lat", lat).withColumn("lon", lon)
    placed = F.when(F.col("lat").isNotNull(), F.col("seq"))
    countries = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("countryLabel").isNotNull(), F.struct("seq", "countryLabel")))), lambda s: s["countryLabel"]))
    return rows.groupBy("qid").agg(F.min_by("itemLabel", "seq").alias("title"), F.min_by("itemDescription", "seq").alias("description"), F.min("day").alias("first_seen"), countries.alias("countries"), F.min_by("lat", placed).alias("lat"), F.min_by("lon", placed).alias("lon"))


def source_catalogue(spark: SparkSession, rows: list[tuple], existing: DataFrame | None = None) -> DataFrame:
    """Rows of the catalogue of sources whose name is not there yet."""
    df = spark.createDataFrame(rows, "name string, url string, kind string, language string, country string, geopolitical_block string, reliability double, active boolean, notes string")
    return df if existing is None else df.join(existing.select("name"), "name", "left_anti")


def last_close(prices: DataFrame) -> DataFrame:
    return prices.where(F.col("close").isNotNull()).groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))
