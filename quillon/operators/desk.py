"""Tables that analysts work with: forecasts, theses, watchlists, trades, and what is shown of them."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import fenced_json

MAP_ROWS, AUTO_OPEN, DEFAULT_PROBABILITY, DEFAULT_DAYS = 3000, 0.6, 0.5, 30
#: The state changes that are allowed, by what is changed.
CHANGES: dict[str, dict[str, list[str]]] = {
    "thesis": {"pending": ["approved", "rejected"]},
    "watchlist": {"active": ["triggered", "expired"]},
    "trade": {"open": ["closed"]},
    "scenario_set": {"active": ["resolved"]},
}
#: Labels of the five buckets of probabilities.
BUCKETS, BOUNDS = ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"], [0.2, 0.4, 0.6, 0.8]
#: Words of the predictions that theses make.
NO_INSTRUMENT, WITHIN, ECONOMIC_DOMAIN = "strumento n/d", "entro", "finanza"

_INDICATORS = "array<struct<label:string,indicator_query:string>>"
_FIELDS = f"title:string,instrument:string,direction:string,horizon_days:int,invalidation:string,confidence:string,trigger_summary:string,causal_chain:array<string>,sources:array<string>,indicators:{_INDICATORS}"
PROPOSALS = f"array<struct<{_FIELDS},alternatives:array<struct<{_FIELDS}>>>>"


# Selections --------------------------------------------------------------------------------------------------------


def selected(df: DataFrame, equal: Mapping[str, object] | None = None, among: Mapping[str, Sequence] | None = None, order: Sequence[str | Column] = ()) -> DataFrame:
    """Rows that meet every condition given: columns equal to a value, and among values. A value of None and an empty
    list ask for nothing, so that all parameters of a page can be passed on."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == F.lit(v))
    for c, values in (among or {}).items():
        df = df.where(F.col(c).isin(list(values))) if values else df
    return df.orderBy(*order) if order else df


def selected_predictions(predictions: DataFrame, domains: DataFrame, resolved: bool | None = None, macro_area: str | None = None, prediction_type: str | None = None, domain: str | None = None) -> DataFrame:
    """Predictions (id, resolved, macro_area, prediction_type, horizon_date, ...) by any of the conditions, the earliest
    horizon first; ``domains`` has prediction_id, domain."""
    out = selected(predictions, {"resolved": resolved, "macro_area": macro_area, "prediction_type": prediction_type})
    if domain is not None:
        out = out.join(domains.where(F.col("domain") == domain).select(F.col("prediction_id").alias("id")), "id", "left_semi")
    return out.orderBy(F.col("horizon_date").asc_nulls_first(), "id")


def map_events(events: DataFrame, kinds: Sequence[str] = (), origins: Sequence[str] = (), since: Column | None = None, most: int = MAP_ROWS) -> DataFrame:
    """Events with coordinates, of the types and origins asked for, from a time on; the newest ``most``."""
    out = selected(events.where("lat is not null and lon is not null"), among={"event_type": kinds, "origin": origins})
    out = out if since is None else out.where(F.col("first_seen") >= since)
    return out.orderBy(F.col("first_seen").desc(), "id").limit(most)


def pair_means(divergences: DataFrame) -> DataFrame:
    """pair, mean, n of the scores of two blocks, the largest mean first."""
    out = divergences.groupBy(F.concat_ws(" ↔ ", "block_a", "block_b").alias("pair")).agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    return out.orderBy(F.col("mean").desc(), "pair")


def alias_conflicts(entities: DataFrame) -> DataFrame:
    """Canonical entities with an id of the knowledge base of which an alias has another type."""
    aliases = entities.where("canonical_entity_id is not null").select(F.col("canonical_entity_id").alias("__to"), F.col("entity_type").alias("__type"))
    linked = entities.where("wikidata_qid is not null")
    return linked.join(aliases, (F.col("id") == F.col("__to")) & (F.col("__type") != F.col("entity_type")), "left_semi")


def story_sizes(events: DataFrame) -> DataFrame:
    """root, n of the stories; an event without a story is one of its own."""
    return events.groupBy(F.coalesce("story_id", "id").alias("root")).agg(F.count(F.lit(1)).alias("n"))


def with_originals(docs: DataFrame) -> DataFrame:
    """Duplicates beside the document that they repeat: id, title, original_id, original_title."""
    original = docs.select(F.col("id").alias("original_id"), F.col("title").alias("original_title"))
    return docs.where("duplicate_of is not null").join(original, F.col("duplicate_of") == F.col("original_id")).select("id", "title", "original_id", "original_title")


# State -------------------------------------------------------------------------------------------------------------


def changed(items: DataFrame, requests: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Items (id, status, ...) after requests (id, seq, status) in the order of seq; a change that is not allowed is
    passed over. Each round makes the first allowed change of every item, so there are as many as a longest chain."""
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, to in allowed.items() for b in to)) if any(allowed.values()) else F.array().cast("array<string>")
    asked = requests.select(F.col("id").alias("__id"), F.col("seq").alias("__seq"), F.col("status").alias("__to"))
    state = items.select("id", "status", F.lit(None).cast(dict(requests.dtypes)["seq"]).alias("__at"))

    def depth(a: str, seen: tuple[str, ...] = ()) -> int:
        return max((1 + depth(b, (*seen, a)) for b in allowed.get(a, ()) if b not in (*seen, a)), default=0)

    if any(a in _reached(allowed, a) for a in allowed):
        raise ValueError("changes that lead back to a state have no longest chain")
    for _ in range(max(map(depth, allowed), default=0)):
        due = asked.join(state, F.col("__id") == F.col("id")).where(F.array_contains(pairs, F.concat_ws(">", "status", "__to")) & (F.col("__at").isNull() | (F.col("__seq") > F.col("__at"))))
        first = due.groupBy("id").agg(F.min(F.struct("__seq", "__to")).alias("__new"))
        state = state.join(first, "id", "left").select("id", F.coalesce("__new.__to", "status").alias("status"), F.coalesce("__new.__seq", "__at").alias("__at"))
    return items.drop("status").join(state.select("id", "status"), "id").select(items.columns)


def _reached(allowed: Mapping[str, Sequence[str]], start: str) -> set[str]:
    found, todo = set(), list(allowed.get(start, ()))
    while todo:
        x = todo.pop()
        if x not in found:
            found.add(x)
            todo += allowed.get(x, ())
    return found


def scope(value: Column, valid: Sequence[str], fallback: str) -> Column:
    return F.when(value.isin(list(valid)), value).otherwise(fallback)


# Theses ------------------------------------------------------------------------------------------------------------


def proposals(answers: DataFrame, most: int = 3) -> DataFrame:
    """Theses out of answers (answer_id, text): a JSON list, maybe in a fence, of which the first ``most`` count, each
    followed by its alternatives. place and alternative (0 is the thesis itself) tell where one stands.

    Text that is no such list gives no rows; a confidence that is not a number is null.
    """
    listed = answers.select("answer_id", F.slice(F.from_json(fenced_json(F.col("text")), PROPOSALS), 1, most).alias("l"))
    own = listed.select("answer_id", F.posexplode("l").alias("place", "t")).where("t is not null")
    names = [f.split(":")[0] for f in _FIELDS.replace(_INDICATORS, "x").split(",")]
    bare = F.array(F.struct(*(F.col(f"t.{n}").alias(n) for n in names)))
    rows = own.select("answer_id", "place", F.posexplode(F.concat(bare, F.coalesce("t.alternatives", F.array().cast(f"array<struct<{_FIELDS}>>")))).alias("alternative", "x"))
    rows = rows.where("x is not null").select("answer_id", "place", "alternative", "x.*")
    chain = F.to_json(F.struct(F.coalesce("causal_chain", F.array().cast("array<string>")).alias("steps"), F.coalesce("trigger_summary", F.lit("")).alias("trigger_summary")))
    return (
        rows.withColumn("confidence", F.col("confidence").try_cast("double"))
        .withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("causal_chain", chain)
        .withColumn("sources_json", F.to_json(F.coalesce("sources", F.array().cast("array<string>"))))
        .withColumn("status", F.lit("pending"))
        .drop("sources", "trigger_summary")
    )


def watchlist(owners: DataFrame, what: str, blank: bool = False) -> DataFrame:
    """owner_id, label, description, indicator_query, status of the indicators of owners (id, indicators). Labels are
    trimmed and must not be empty, unless ``blank`` lets them be."""
    rows = owners.select(F.col("id").alias("owner_id"), F.explode("indicators").alias("i")).where("i is not null")
    label = F.coalesce("i.label", F.lit(""))
    rows = rows.withColumn("label", label if blank else F.trim(label))
    rows = rows if blank else rows.where("label <> ''")
    return rows.select("owner_id", "label", F.concat(F.lit(f"{what} "), F.col("owner_id").cast("string"), F.lit(": "), "label").alias("description"), F.coalesce("i.indicator_query", F.lit("")).alias("indicator_query"), F.lit("active").alias("status"))


def auto_opened(theses: DataFrame, threshold: float = AUTO_OPEN) -> DataFrame:
    """Pending theses that are confident enough to be approved and traded without review."""
    return theses.where((F.col("status") == "pending") & (F.col("confidence").try_cast("double") >= threshold))


def thesis_predictions(theses: DataFrame, today: Column) -> DataFrame:
    """The economic prediction of each thesis: the confidence within 0 and 1 as its probability, one half without one."""
    days = F.coalesce("horizon_days", F.lit(DEFAULT_DAYS))
    what = F.concat_ws(" ", F.nullif("instrument", F.lit("")), F.nullif("direction", F.lit("")))
    what = F.when(what == "", NO_INSTRUMENT).otherwise(what)
    return theses.select(
        F.col("id").alias("thesis_id"),
        F.concat(what, F.lit(f" {WITHIN} "), days.cast("string"), F.lit("gg — "), "title").alias("description"),
        F.when(F.col("confidence").isNull(), DEFAULT_PROBABILITY).otherwise(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))).alias("probability"),
        F.date_add(today, days).cast("string").alias("horizon_date"),
        F.lit("economic").alias("macro_area"),
        F.lit("economic").alias("prediction_type"),
        F.array(F.lit(ECONOMIC_DOMAIN)).alias("domains"),
    )


def linked_to_trades(predictions: DataFrame, trades: DataFrame) -> DataFrame:
    """Predictions (id, thesis_id, macro_area, trade_id, resolved, ...) after trades (trade_id, thesis_id) were opened:
    the oldest open economic one of the thesis that has no trade takes the first."""
    free = predictions.where("macro_area = 'economic' and trade_id is null and not resolved and thesis_id is not null")
    oldest = free.groupBy("thesis_id").agg(F.min("id").alias("id"))
    taken = oldest.join(trades.groupBy("thesis_id").agg(F.min("trade_id").alias("__trade")), "thesis_id").select("id", "__trade")
    return predictions.join(taken, "id", "left").withColumn("trade_id", F.coalesce("trade_id", "__trade")).drop("__trade").select(predictions.columns)


def random_control(ids: Column, pool: Sequence[str]) -> Column:
    """The ticker that a seeded generator picks for an id; the sequence is that of Python's own, so it is a pandas UDF."""
    pool = list(pool)

    def pick(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: random.Random(int(i)).choice(pool), na_action="ignore")

    return F.pandas_udf(pick, "string")(ids)


# Calibration -------------------------------------------------------------------------------------------------------


def calibration_report(predictions: DataFrame, areas: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """section, label, n, mean_brier, mean_time_adjusted, accuracy of resolved predictions: all of them, five buckets of
    probability (empty ones too, the last one closed), and the areas and types that occur, valid ones only. Without resolved
    predictions there are the empty buckets alone.

    ``predictions``: probability, resolved, outcome, outcome_eventual, brier_score, time_adjusted_score, macro_area,
    prediction_type. Means leave out nulls. accuracy is the share that happened, by the eventual outcome where there is
    one, and of buckets only. The sections are one grouping over sets, so the table is read and shuffled once.
    """
    p = F.col("probability")
    bucket = F.when((p < 0) | (p > 1) | p.isNull(), None)
    for k, bound in enumerate(BOUNDS):
        bucket = bucket.when(p < bound, k)
    bucket = bucket.otherwise(len(BOUNDS))
    own = predictions.where("resolved").select(
        F.when(F.col("macro_area").isin(list(areas)), F.col("macro_area")).alias("area"),
        F.when(F.col("prediction_type").isin(list(kinds)), F.col("prediction_type")).alias("kind"),
        bucket.cast("int").alias("bucket"), "brier_score", "time_adjusted_score",
        F.coalesce("outcome_eventual", "outcome").alias("happened"),
    )
    c = F.col
    sets = own.groupingSets([[], ["bucket"], ["area"], ["kind"]], "bucket", "area", "kind").agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).alias("n"), F.avg("brier_score").alias("mean_brier"), F.avg("time_adjusted_score").alias("mean_time_adjusted"),
        F.avg(F.when(c("happened"), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    section = F.when(c("g") == 7, "overall").when(c("g") == 3, "bucket").when(c("g") == 5, "area").otherwise("type")
    found = sets.select(section.alias("section"), "bucket", F.coalesce("area", "kind").alias("name"), "n", "mean_brier", "mean_time_adjusted", "accuracy")
    rest = found.where("section <> 'bucket'").where("section = 'overall' or name is not null")
    rest = rest.select("section", F.coalesce("name", F.lit("all")).alias("label"), "n", "mean_brier", "mean_time_adjusted", F.lit(None).cast("double").alias("accuracy"))
    frame = predictions.sparkSession.createDataFrame(list(enumerate(BUCKETS)), "bucket int, label string")
    own = frame.join(found.where("section = 'bucket'").drop("name"), "bucket", "left")
    return rest.unionByName(own.select(F.lit("bucket").alias("section"), "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_brier", "mean_time_adjusted", "accuracy"))
