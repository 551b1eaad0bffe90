"""Deduplication, upserts, purges and joins that an embedded store does with keys and triggers, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.storage import discard, written


def _all_null_free(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], existing: DataFrame | None = None) -> DataFrame:
    """Of rows with equal keys the first in ``order`` stays, unless ``existing`` has the key. Rows with a null in the
    key never conflict with any other."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    keyed = df.where(_all_null_free(keys)).withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    if existing is not None:
        keyed = keyed.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return keyed.unionByName(df.where(~_all_null_free(keys)))


def insert_or_ignore(df: DataFrame, unique: Sequence[Sequence[str]], order: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """The rows that a store with several unique keys takes, one after the other in ``order``: a row goes if one that
    was taken before, or is in ``existing``, has any of its keys. Nulls never conflict; ``order`` tells rows apart.

    In each round the rows that come first for all their keys are taken, and those that conflict with them go, until
    none is left; the first row of all is taken in every round, so it ends.
    """
    left = df
    if existing is not None:
        for keys in unique:
            left = left.join(existing.select(*keys).distinct(), list(keys), "left_anti").select(df.columns)
    place, taken = F.struct(*order), None
    left = written(left, "left")
    while not left.isEmpty():
        first = left
        for k, keys in enumerate(unique):
            low = left.where(_all_null_free(keys)).groupBy(*keys).agg(F.min(place).alias(f"__low{k}"))
            first = first.join(low, list(keys), "left")
            first = first.where(F.col(f"__low{k}").isNull() | (F.col(f"__low{k}") == place)).select(df.columns)
        first = written(first, "taken")
        taken = first if taken is None else taken.unionByName(first)
        left = left.join(first.select(*order), list(order), "left_anti").select(df.columns)
        for keys in unique:
            left = left.join(first.where(_all_null_free(keys)).select(*keys).distinct(), list(keys), "left_anti").select(df.columns)
        left = written(left, "left")
    return left if taken is None else taken


def last_wins(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Upsert: for each key the row with the largest ``order``, the batch before the existing rows at ties."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("__new"))).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(existing.columns)


def column_upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace only ``columns`` where the batch has a value; keys of either side stay."""
    new = batch.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = existing.join(new, list(keys), "full_outer")
    return joined.select(*keys, *(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns if c not in keys))


def additive_upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counts of equal keys are added; all other columns of a key that exists stay, those of a new one are the batch's
    (of its several rows the one with the smallest values)."""
    rest = [c for c in existing.columns if c not in keys and c not in columns]
    both = existing.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    first = F.min(F.struct("__new", *rest)).alias("__r")
    out = both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns), first)
    return out.select(*(F.col(f"__r.{c}").alias(c) if c in rest else F.col(c) for c in existing.columns))


def insert_if_absent(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the existing table does not have; of several new ones any one."""
    return df.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def refresh(existing: DataFrame, new: DataFrame, partition: Column) -> DataFrame:
    """Delete the rows of a partition and put new ones in their place."""
    return existing.where(~partition | partition.isNull()).unionByName(new)


def purge_origin(tables: dict[str, DataFrame], origin: str) -> dict[str, DataFrame]:
    """All tables without what came from one origin: documents, their bridges, vectors and mentions, the events of the
    origin and their details, events left without documents that had some, entities left without mentions, and links
    of those."""
    docs = tables["documents"]
    gone_docs = docs.where(F.col("origin") == origin).select(F.col("id").alias("document_id"))
    events, bridge = tables["events"], tables["event_documents"]
    kept_bridge = bridge.join(gone_docs, "document_id", "left_anti")
    had = bridge.select(F.col("event_id").alias("id")).distinct()
    has = kept_bridge.select(F.col("event_id").alias("id")).distinct()
    orphaned = had.join(has, "id", "left_anti")
    gone_events = events.where(F.col("origin") == origin).select("id").union(orphaned).distinct()
    out = dict(tables)
    out["documents"] = docs.where(F.col("origin").isNull() | (F.col("origin") != origin))
    out["events"] = events.join(gone_events, "id", "left_anti")
    out["event_documents"] = kept_bridge.join(gone_events.withColumnRenamed("id", "event_id"), "event_id", "left_anti").select(bridge.columns)
    for name in ("vectors", "mentions"):
        if name in tables:
            out[name] = tables[name].join(gone_docs, "document_id", "left_anti").select(tables[name].columns)
    if "entities" in tables and "mentions" in tables:
        lost = tables["mentions"].select("entity_id").distinct().join(out["mentions"].select("entity_id").distinct(), "entity_id", "left_anti").withColumnRenamed("entity_id", "id")
        out["entities"] = tables["entities"].join(lost, "id", "left_anti")
        if "links" in tables:
            links = tables["links"]
            for end in ("entity_a", "entity_b"):
                links = links.join(lost.withColumnRenamed("id", end), end, "left_anti")
            out["links"] = links.select(tables["links"].columns)
    return out


def purge_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Dry run: rows that a purge would delete, by table."""
    counts = None
    for name in before:
        n = before[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.col("n").alias("b"))
        m = after[name].agg(F.count(F.lit(1)).alias("a"))
        row = n.crossJoin(m).select("table_name", (F.col("b") - F.col("a")).alias("deleted"))  # one row each
        counts = row if counts is None else counts.unionByName(row)
    return counts


def latest_state(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest entry of an append-only log for each key."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def anti_null_safe(df: DataFrame, column: str, excluded: Sequence[str]) -> DataFrame:
    """column IS NULL OR column NOT IN excluded."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(excluded)))


#: Rows of one partition of ``spread``.
SPREAD_ROWS = 250_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into partitions whose number grows with the rows, so that what joins and groups them by these
    keys needs no more memory in a task for a larger table. Adaptive execution leaves a number that is asked for alone,
    while it would merge partitions by their compressed size, before joins multiply their rows."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(parts, *keys)


def union_degree(edges: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Number (or weight) of edges at either end of each node. Edges are read once for both ends; there is no OR join."""
    value = F.sum(weight) if weight else F.count(F.lit(1))
    ends = edges.select(F.explode(F.array(a, b)).alias("node"), *([weight] if weight else []))
    return ends.groupBy("node").agg(value.alias("degree"))


def expand_pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs a < b of the distinct items of each group: an equi-join on the group with a residual condition."""
    own = df.select(group, item).distinct()
    left, right = own.withColumnRenamed(item, "a"), own.withColumnRenamed(item, "b")
    return left.join(right, group).where("a < b")


def induced_subgraph(edges: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with both ends among the nodes (column node)."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", a), a, "left_semi").join(keep.withColumnRenamed("node", b), b, "left_semi")


def merge_aliases(edges: DataFrame, aliases: DataFrame, weight: str = "strength") -> DataFrame:
    """Edges between canonical nodes: aliases (id, canonical_id) resolved by one hop, self loops dropped, weights added."""
    out = edges
    for end in ("a", "b"):
        ptr = aliases.select(F.col("id").alias(end), F.col("canonical_id").alias(f"__{end}"))
        out = out.join(ptr, end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    return out.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(weight).alias(weight))


def majority(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Most frequent value by key; of equals the one met first in ``order``. Nulls do not count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*order)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__n").desc(), F.col("__first")))
    return n.withColumn("__r", rank).where("__r = 1").select(*keys, value)


def first_non_empty(value: str, order: Sequence[str]) -> Column:
    """Aggregate: the first non-empty value by order."""
    kept = F.when(F.col(value) != "", F.col(value))
    return F.min_by(kept, F.when(kept.isNotNull(), F.struct(*order)))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts by key of two snapshots, keys of either side, missing as 0, and their difference."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("n_after"))
    out = b.join(a, key, "full_outer").na.fill(0, ["n_before", "n_after"])
    return out.withColumn("delta", F.col("n_after") - F.col("n_before"))


def pivot_with_total(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and column value, 0 where there are none, and the row's total over all columns."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.groupBy(row).agg(*counts, F.count(F.lit(1)).alias("total"))


def only_from(df: DataFrame, key: str, value: str, wanted: str) -> DataFrame:
    """Keys all of whose rows have one value."""
    return df.groupBy(key).agg(F.bool_and(F.coalesce(F.col(value) == wanted, F.lit(False))).alias("__all")).where("__all").select(key)


def resolve_pointers(df: DataFrame, id_col: str, pointer: str, transitive: bool = False) -> DataFrame:
    """id and the id that its pointer leads to: one hop, or followed to the end, each round twice as far. A pointer to an
    id that no row has ends there; a circle leads to the smallest id in it."""
    ptr = df.select(F.col(id_col).alias("id"), F.coalesce(pointer, id_col).alias("canonical"))
    if not transitive:
        return ptr
    # low: the smallest id passed so far. A walk longer than there are rows goes round a circle.
    out = written(ptr.withColumn("low", F.least("id", "canonical")), "pointers")
    rows, reach = out.count(), 1
    while True:
        hop = out.select(F.col("id").alias("canonical"), F.col("canonical").alias("next"), F.col("low").alias("further"))
        after = written(out.join(hop, "canonical", "left").select("id", F.coalesce("next", "canonical").alias("canonical"), F.least("low", "further").alias("low")), "pointers")
        moved = not after.join(out.select("id", F.col("canonical").alias("before")), "id").where("canonical <> before").isEmpty()
        discard(out)
        out, reach = after, 2 * reach
        if not moved or reach > rows:
            break
    ends = out.join(ptr.select(F.col("id").alias("canonical"), F.col("canonical").alias("next")), "canonical", "left")
    # The end of a walk that has not ended is in a circle: from there the smallest id passed is the circle's.
    circle = out.select(F.col("id").alias("canonical"), F.col("low").alias("least"))
    return ends.join(circle, "canonical", "left").select("id", F.when(F.col("next").isNotNull() & (F.col("next") != F.col("canonical")), F.col("least")).otherwise(F.col("canonical")).alias("canonical"))


def seeded_sample(df: DataFrame, strata: Sequence[str], id_col: str, n: int, seed: int | str) -> DataFrame:
    """The ``n`` rows of each stratum whose keyed hashes are smallest: the same ones at any partitioning and order.

    Each task keeps the n smallest hashes of each stratum of its own rows, so only those are shuffled and ranked; then the
    rows are found again by id, which tells rows apart. Null strata count as one; rows without an id are never drawn.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    own = df.where(F.col(id_col).isNotNull()).select(*strata, F.col(id_col), key.alias("__key"))

    def smallest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in parts:
            both = pdf if held is None else pd.concat([held, pdf])
            ranked = both.sort_values("__key")
            held = ranked.groupby(list(strata), dropna=False, sort=False).head(n) if strata else ranked.head(n)
        if held is not None:
            yield held

    order = Window.partitionBy(*strata).orderBy("__key", id_col)
    drawn = own.mapInPandas(smallest, own.schema).withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n)
    return df.join(drawn.select(id_col), id_col, "left_semi")


def exact_quantiles(df: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """group, n and an array of quantiles (between neighbouring values, as by rank) of the values that are not null.

    Rows are range-partitioned by group and value and sorted inside; partitions are counted, which gives each row its
    rank, and only the rows at the wanted ranks are picked. No group's values meet in one task or buffer; a value that
    is very frequent is dealt to several partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    ranged = own.repartitionByRange(parts, "g", "x", "deal").sortWithinPartitions("g", "x")
    placed = written(ranged.select("g", "x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranged")
    # A row for each partition of each group: what is before it in the group.
    heads = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("g").orderBy("part")
    heads = heads.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    spot = lambda q: (F.col("total") - 1) * F.lit(float(q))
    heads = heads.select(F.col("g").alias("of"), F.col("part").alias("own"), "first", "before", "total")
    ranked = placed.join(heads, F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("own"))).select("g", "x", "total", (F.col("before") + F.col("at") - F.col("first")).alias("rank"))
    wanted = F.array(*(f(spot(q)).cast("long") for q in shares for f in (F.floor, F.ceil)))
    picked = ranked.where(F.array_contains(wanted, F.col("rank")))
    at = lambda q, f: F.max(F.when(F.col("rank") == f(spot(q)).cast("long"), F.col("x")))
    between = [(at(q, F.floor) + (at(q, F.ceil) - at(q, F.floor)) * F.max(spot(q) - F.floor(spot(q)))) for q in shares]
    return picked.groupBy(F.col("g").alias(group)).agg(F.max("total").alias("n"), F.array(*between).alias("quantiles"))
