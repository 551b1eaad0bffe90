"""Checks of the tables' state: how fresh they are, what is left to do, what is overdue. Each is one row:
section, name, status (ok, warn, skip) and detail. A table that is missing is passed as None and skipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalar import age_label

RESULT = "section string, name string, status string, detail string"


@dataclass(frozen=True)
class Fresh:
    """The newest ``time`` of a table must not be older than so many hours."""

    name: str
    table: DataFrame | None
    time: str
    hours: float
    hint: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class Backlog:
    """Fewer rows than ``most`` may wait in a table for which the condition holds."""

    name: str
    table: DataFrame | None
    waiting: Column
    most: int
    hint: str = ""


@dataclass(frozen=True)
class Overdue:
    """None of a table's open rows may be past its time."""

    name: str
    table: DataFrame | None
    open: Column
    late: Column


def _row(df: DataFrame, section: str, name: str, status: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.lit(name).alias("name"), status.alias("status"), detail.alias("detail"))


def checks(spark: SparkSession, now: Column, fresh: list[Fresh] = [], backlogs: list[Backlog] = [], overdue: list[Overdue] = []) -> DataFrame:  # noqa: B006
    """One row for each check; each is one aggregate that is combined before it is shuffled."""
    out = spark.createDataFrame([], RESULT)
    skipped = lambda section, name, why: spark.createDataFrame([(section, name, "skip", why)], RESULT)
    hint = lambda h: f" — `{h}`" if h else ""
    for c in fresh:
        if not c.enabled or c.table is None:
            out = out.unionByName(skipped("freshness", c.name, "table missing" if c.enabled else "source disabled"))
            continue
        last = c.table.agg(F.max(c.time).alias("t")).withColumn("age", (now.cast("timestamp").cast("double") - F.col("t").try_cast("timestamp").cast("double")) / 3600)
        status = F.when(F.col("age") <= c.hours, "ok").otherwise("warn")
        detail = F.when(F.col("t").isNull(), f"no data yet{hint(c.hint)}").when(F.col("age").isNull(), F.concat(F.lit("unparseable timestamp "), F.col("t").cast("string")))
        detail = detail.otherwise(F.concat(F.lit("last data "), age_label(F.col("age")), F.when(F.col("age") > c.hours, hint(c.hint)).otherwise("")))
        out = out.unionByName(_row(last, "freshness", c.name, status, detail))
    for c in backlogs:
        if c.table is None:
            out = out.unionByName(skipped("backlog", c.name, "table missing"))
            continue
        n = c.table.agg(F.count_if(c.waiting).alias("n"))
        late = F.col("n") >= c.most
        out = out.unionByName(_row(n, "backlog", c.name, F.when(late, "warn").otherwise("ok"), F.concat(F.col("n").cast("string"), F.lit(" pending"), F.when(late, hint(c.hint)).otherwise(""))))
    for c in overdue:
        if c.table is None:
            out = out.unionByName(skipped("state", c.name, "table missing"))
            continue
        n = c.table.agg(F.count_if(c.open).alias("n"), F.count_if(c.open & c.late).alias("late"))
        detail = F.when(F.col("late") > 0, F.concat(F.col("late").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" past their time"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" open, none past their time")))
        out = out.unionByName(_row(n, "state", c.name, F.when(F.col("late") > 0, "warn").otherwise("ok"), detail))
    return out
