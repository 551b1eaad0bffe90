"""Entities in documents: extraction seam, canonical rows, co-occurrence, places of events."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.functions.lookups import AMBIGUOUS, place_label
from quillon.functions.scalar import clean_name, last_token, person_key
from quillon.operators.relational import spread

DOMINANCE = 3


def extracted(docs: DataFrame, model: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]], labels: dict[str, str], stop: list[str] | DataFrame) -> DataFrame:
    """document_id, name, entity_type, mentions. ``model`` is loaded once for each task and gives (text, label) lists.

    Names in ``stop``, whatever their case, are left out; a table of them (name) may have any size.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = model()
        for pdf in parts:
            found = find(pdf["text"].fillna("").tolist())
            rows = [(d, t, k) for d, ents in zip(pdf["document_id"], found, strict=True) for t, k in ents]
            yield pd.DataFrame(rows, columns=["document_id", "name", "label"])

    found = docs.select("document_id", "text").mapInPandas(run, "document_id long, name string, label string")
    kind = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col("label")]
    named = found.withColumn("name", clean_name(F.col("name"))).withColumn("entity_type", kind)
    kept = named.where(F.col("name").isNotNull() & F.col("entity_type").isNotNull())
    counted = kept.groupBy("document_id", "name", "entity_type").agg(F.count(F.lit(1)).alias("mentions"))
    return without_listed(counted, "name", stop)


def without_listed(df: DataFrame, column: str, stop: list[str] | DataFrame) -> DataFrame:
    """Rows whose name is not in a list, whatever its case: a condition for a list at hand, a join for a table (name)."""
    own = F.lower(F.col(column))
    if isinstance(stop, DataFrame):
        return df.join(stop.select(F.lower("name").alias("__stop")).distinct(), own == F.col("__stop"), "left_anti")
    return df.where(~own.isin([s.lower() for s in stop]) | own.isNull())


def canonical_people(entities: DataFrame) -> DataFrame:
    """id, canonical_id of people (id, name, mentions) that are variants of another.

    Names of two words or more with one key (titles stripped) go to the most mentioned, of equals the smallest id. A
    bare surname goes to the one longer name that ends in it, or to the most mentioned of several if that has three
    times the mentions of the next (or the next has none); else it stays.
    """
    keyed = entities.withColumn("key", person_key(F.col("name"))).withColumn("n_tokens", F.size(F.split("key", " ")))
    full = keyed.where("n_tokens >= 2").groupBy("key").agg(F.max(F.struct("mentions", (-F.col("id")).alias("neg"))).alias("top"))
    full = full.select("key", (-F.col("top.neg")).alias("target"), F.col("top.mentions").alias("m"))
    variants = keyed.where("n_tokens >= 2").join(full, "key").where("id <> target").select("id", F.col("target").alias("canonical_id"))
    order = Window.partitionBy("surname").orderBy(F.col("m").desc(), "target")
    ranked = full.withColumn("surname", last_token(F.col("key"))).withColumn("next_m", F.lead("m").over(order)).withColumn("r", F.row_number().over(order)).where("r = 1")
    clear = ranked.where(F.col("next_m").isNull() | (F.col("next_m") <= 0) | (F.col("m") >= DOMINANCE * F.col("next_m"))).select("surname", "target")
    bare = keyed.where("n_tokens = 1").join(clear, F.col("key") == F.col("surname")).select("id", F.col("target").alias("canonical_id"))
    return variants.union(bare)


def canonical_places(entities: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """id, canonical_id, label of places (id, name, mentions) that name one place in different words; of each label the
    most mentioned row is canonical.

    A name's label is that of ``keys`` (name in lower case, label) where it has an entry, else the country that it is an
    adjective of, else the one that it is an alias of; other names are labels themselves, whatever their case, so that a
    country's own name meets its other words.
    """
    label = place_label(F.col("name"))
    own = entities
    if keys is not None:
        own = own.join(keys.select(F.col("name").alias("__name"), F.col("label").alias("__label")).dropDuplicates(["__name"]), F.lower("name") == F.col("__name"), "left")
        label = F.coalesce("__label", label)
    own = own.withColumn("label", F.coalesce(label, "name")).withColumn("__key", F.lower("label"))
    top = own.groupBy("__key").agg(F.max(F.struct("mentions", (-F.col("id")).alias("neg"))).alias("t"), F.min(F.when(F.lower("name") != F.lower("label"), F.col("label"))).alias("known"), F.count(F.lit(1)).alias("n"))
    out = own.join(top.where("n >= 2"), "__key")
    return out.select("id", (-F.col("t.neg")).alias("canonical_id"), F.coalesce("known", "label").alias("label"))


def retyped(mentions: DataFrame, entities: DataFrame, new_type: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities with a new type; rows that then collide on (name, type) become one and their mentions are added.

    Returns entities, mentions, and id -> kept id, to re-point edges with.
    """
    typed = entities.withColumn("entity_type", new_type)
    kept = typed.groupBy("name", "entity_type").agg(F.min("id").alias("kept"))
    moved = typed.join(kept, ["name", "entity_type"]).select("id", "kept")
    out = typed.join(moved.where("id = kept").select("id"), "id", "left_semi")
    added = mentions.join(moved.withColumnRenamed("id", "entity_id"), "entity_id").groupBy("document_id", F.col("kept").alias("entity_id")).agg(F.sum("mentions").alias("mentions"))
    return out, added, moved


def repointed(edges: DataFrame, moved: DataFrame, weight: str = "strength") -> DataFrame:
    """Edges (entity_a, entity_b, weight) between the rows that are kept (id -> kept): loops go, and edges that then are
    the same become the strongest of them."""
    a, b = (moved.select(F.col("id").alias(c), F.col("kept").alias(f"__{c}")) for c in ("entity_a", "entity_b"))
    out = edges.join(a, "entity_a", "left").join(b, "entity_b", "left")
    x, y = F.coalesce("__entity_a", "entity_a"), F.coalesce("__entity_b", "entity_b")
    out = out.select(F.least(x, y).alias("entity_a"), F.greatest(x, y).alias("entity_b"), weight).where("entity_a <> entity_b")
    return out.groupBy("entity_a", "entity_b").agg(F.max(weight).alias(weight))


def without_noise(entities: DataFrame, noise: list[str]) -> DataFrame:
    """Entities that are not noise; pointers to noise rows become null."""
    bad = entities.where(F.lower("name").isin([x.lower() for x in noise])).select(F.col("id").alias("__bad"))
    kept = entities.join(bad, entities["id"] == bad["__bad"], "left_anti")
    out = kept.join(bad, kept["canonical_entity_id"] == bad["__bad"], "left")
    return out.withColumn("canonical_entity_id", F.when(F.col("__bad").isNull(), F.col("canonical_entity_id"))).drop("__bad")


def cooccurrence(mentions: DataFrame, item: str = "entity_id", group: str = "document_id", least: int = 1, count: str | None = None) -> DataFrame:
    """a, b, n, strength of the pairs a < b that stand in one group; n counts distinct groups (or ``count`` values), and
    strength is n / 10, at most 1."""
    own = spread(mentions.select(group, item, *([count] if count else [])), group).distinct()
    cols = [group, F.col(item).alias("a")] + ([F.col(count)] if count else [])
    pairs = own.select(*cols).join(own.select(group, F.col(item).alias("b")).distinct(), group).where("a < b")
    # Items of a group are distinct, so each pair stands once in it.
    n = F.count_distinct(count) if count else F.count(F.lit(1))
    out = pairs.groupBy("a", "b").agg(n.alias("n")).where(F.col("n") >= least)
    return out.withColumn("strength", F.least(F.lit(1.0), F.col("n") / 10.0))


def major_powers(mentions: DataFrame, n: int = 8) -> DataFrame:
    """The places in most documents: country, n_docs; of equals the first by name. ``mentions`` has document_id and country,
    or a row for each document with the distinct countries of it, which are counted as they are."""
    if "countries" in mentions.columns:
        counted = mentions.where("document_id is not null").select(F.explode("countries").alias("country")).groupBy("country").agg(F.count(F.lit(1)).alias("n_docs"))
    else:
        counted = mentions.groupBy("country").agg(F.count_distinct("document_id").alias("n_docs"))
    return counted.orderBy(F.col("n_docs").desc(), "country").limit(n)


def classified_place(countries: Column, majors: Column) -> tuple[Column, Column]:
    """Decision and place of an event from the countries that it mentions: none; the only one; only major powers; the
    one minor beside one major at most; else ambiguous."""
    uniq = F.array_distinct(F.coalesce(countries, F.array().cast("array<string>")))
    minor = F.array_except(uniq, majors)
    n, n_minor = F.size(uniq), F.size(minor)
    lone = (n > 1) & (n_minor == 1) & (n - n_minor <= 1)
    decision = F.when(n == 0, "skip_none").when(n == 1, "located").when(n_minor == 0, "skip_bilateral").when(lone, "located").otherwise("ambiguous")
    return decision, F.when(n == 1, F.get(uniq, F.lit(0))).when(lone, F.get(minor, F.lit(0)))


def geocoded(events: DataFrame, cache: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Events with coordinates from the cache (query, lat, lon; misses cached as null), and the queries that it lacks,
    the most frequent first, within the budget of lookups."""
    known = cache.select(F.col("query").alias("__q"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    joined = events.join(known, events["location_name"] == known["__q"], "left")
    located = joined.withColumn("lat", F.coalesce("lat", "__lat")).withColumn("lon", F.coalesce("lon", "__lon"))
    todo = located.where("lat is null and location_name is not null and __q is null").groupBy("location_name").agg(F.count(F.lit(1)).alias("n"))
    return located.drop("__q", "__lat", "__lon"), todo.orderBy(F.col("n").desc(), "location_name").limit(most)


def linked_qids(entities: DataFrame, lookup: DataFrame) -> DataFrame:
    """Entities with the id that a lookup (name, entity_type, qid, and maybe found_type) gives; of several rows with one
    id one keeps it and the others point to that row.

    The keeper is one whose type is the one that the knowledge base gives (found_type), of those the most mentioned. A
    name that stands for a country and something else is linked only where found_type says that it is the same thing.
    """
    typed = "found_type" in lookup.columns
    cols = ["name", "entity_type", F.col("qid").alias("__qid"), (F.col("found_type") if typed else F.lit(None).cast("string")).alias("__type")]
    found = entities.join(lookup.select(*cols), ["name", "entity_type"], "left")
    right = F.coalesce(F.col("__type") == F.col("entity_type"), F.lit(False))
    found = found.withColumn("__qid", F.when(right | ~F.lower("name").isin(AMBIGUOUS), F.col("__qid")))
    # The best of each id is a grouped maximum, combined before it is shuffled.
    best = found.where("__qid is not null").groupBy("__qid").agg(F.max(F.struct(right.alias("r"), F.col("mentions"), (-F.col("id")).alias("neg"))).alias("t"))
    out = found.join(best.select("__qid", (-F.col("t.neg")).alias("__first")), "__qid", "left")
    qid = F.when(F.col("__first") == F.col("id"), F.col("__qid"))
    pointer = F.when(F.col("__first") != F.col("id"), F.col("__first"))
    out = out.withColumn("wikidata_qid", qid).withColumn("canonical_entity_id", F.coalesce(pointer, F.col("canonical_entity_id")))
    return out.drop("__qid", "__first", "__type")


#: Characters of the terms of one turn's indicators: what every task holds, as one automaton.
TERM_CHARS = 2_000_000
#: Titles whose text and matches a task holds at once beside the batch that it reads.
TITLES = 128


class TermAutomaton:
    """Terms of indicators in one Aho-Corasick automaton: all that a text holds are found in one pass over it."""

    def __init__(self, indicators: list[list[str]]) -> None:
        import ahocorasick

        number: dict[str, int] = {}
        of, times = [], []
        for k, terms in enumerate(indicators):
            for term, n in Counter(terms).items():
                at = number.setdefault(term, len(number))
                if at == len(of):
                    of.append([])
                    times.append([])
                of[at].append(k)
                times[at].append(n)
        self.size = len(indicators)
        self.needs = np.array([len(t) if len(t) <= 2 else -(-len(t) // 2) for t in indicators])
        self.of, self.times = [np.array(x) for x in of], [np.array(x) for x in times]
        self.automaton = ahocorasick.Automaton()
        for term, at in number.items():
            self.automaton.add_word(term, at)
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(indicator, terms that the text holds) of the indicators that hold enough."""
        found = {at for _, at in self.automaton.iter(text)} if self.of else ()
        if not found:
            return []
        hits = np.bincount(np.concatenate([self.of[at] for at in found]), np.concatenate([self.times[at] for at in found]), self.size).astype(np.int64)
        enough = np.flatnonzero((hits >= self.needs) & (hits > 0))
        return list(zip(enough.tolist(), hits[enough].tolist(), strict=True))


def triggered(indicators: DataFrame, titles: DataFrame, term_chars: int = TERM_CHARS) -> DataFrame:
    """indicator_id, event_id, n_hits where a title holds half of an indicator's terms or more (both of two, or the one).

    Terms are what white space delimits, of three characters or more, in lower case; repeated ones count each time. A
    term is found anywhere in a title, also within a word. The indicators are cut into turns of ``term_chars`` characters
    of terms, each turn's terms go to the tasks as one automaton, and each task reads its titles once: the work grows with
    the titles' length and with what is found in them, not with titles times indicators.
    """
    spark = titles.sparkSession
    kind_i, kind_e = (dict(df.dtypes)[c] for df, c in ((indicators, "indicator_id"), (titles, "event_id")))
    terms = F.filter(F.split(F.lower(F.trim("label")), r"\s+"), lambda w: F.length(w) > 2)
    own = indicators.select("indicator_id", terms.alias("terms")).where("size(terms) > 0")
    chars = own.agg(F.sum(F.length(F.array_join("terms", "")))).first()[0] or 0
    turns = -(-chars // term_chars)
    lower = titles.where("title is not null").select("event_id", F.lower("title").alias("title"))
    out = spark.createDataFrame([], f"indicator_id {kind_i}, event_id {kind_e}, n_hits int")
    schema = to_arrow_schema(out.schema)

    def of_turn(turn: int) -> DataFrame:
        held = own.where(F.pmod(F.xxhash64("indicator_id"), F.lit(turns)) == turn).collect()  # about term_chars characters
        ids, lists = [r.indicator_id for r in held], [list(r.terms) for r in held]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = TermAutomaton(lists)
            # A long title may match every indicator, so matches leave after a few titles.
            for batch in (whole.slice(at, TITLES) for whole in parts for at in range(0, whole.num_rows, TITLES)):
                found = [(ids[k], e, n) for e, title in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, n in automaton.matches(title)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        return lower.mapInArrow(run, out.schema)

    for turn in range(turns):
        out = out.unionByName(of_turn(turn))
    return out


def fired(items: DataFrame, matches: DataFrame, now: Column) -> DataFrame:
    """Watchlist items (id, status, triggered_at) after matches (indicator_id, event_id): active ones with a match are
    triggered, once; others stay as they are."""
    hit = matches.select(F.col("indicator_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    joined = items.join(hit, "id", "left")
    fires = F.col("__hit").isNotNull() & (F.col("status") == "active")
    return joined.withColumn("triggered_at", F.when(fires, now).otherwise(F.col("triggered_at"))).withColumn("status", F.when(fires, "triggered").otherwise(F.col("status"))).drop("__hit")


def dossier(parts: list[tuple[str, DataFrame, Column, int]]) -> DataFrame:
    """Evidence E1, E2, ... from several frames (kind, frame with text, order, most rows each), in their order."""
    out = None
    for k, (kind, df, order, most) in enumerate(parts):
        top = df.orderBy(order, "text").limit(most).select(F.lit(k).alias("part"), F.lit(kind).alias("kind"), F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(order, "text")).alias("place"), "text")
        out = top if out is None else out.unionByName(top)
    seq = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "place"))  # a few capped rows
    return out.select(F.concat(F.lit("E"), seq.cast("string")).alias("evidence_id"), "kind", "text")
