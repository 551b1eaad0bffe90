"""Incremental forms: file streams with a checkpoint, deduplication within a watermark, upserts and baselines by batch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.relational import last_wins
from quillon.operators.series import LEAST_BASELINE


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 200, **options: str) -> DataFrame:
    """A stream of files; its checkpoint remembers which were read, so each file counts once."""
    return spark.readStream.schema(schema).format(kind).options(**options).option("maxFilesPerTrigger", files_per_batch).load(path)


def drain(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process all that is there in batches, and stop."""
    query = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def deduplicated(df: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; a key is remembered as long as the watermark delay."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(df: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Counts by day; late rows count until the watermark passes their day."""
    return df.withWatermark(time, delay).groupBy(*keys, F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("day"), "n")


#: Buckets of a table that batches are merged into.
BUCKETS = 64


def upsert_into(spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the newest row of each key, in a table of folders by a hash of the key.

    A batch reads and overwrites the buckets of its own keys only; the others' files stay as they are. A batch that runs
    again finds its own rows there and leaves the same.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        columns = batch.columns
        batch = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), F.col(order)).alias("r")).select(*keys, "r.*").select(columns)
        batch = batch.withColumn("bucket", bucket).persist()
        try:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            table, target = batch, spark._jvm.org.apache.hadoop.fs.Path(path)
            if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
                old = spark.read.schema(batch.schema).parquet(path).where(F.col("bucket").isin(touched))
                table = last_wins(old, batch, [*keys, "bucket"], order)
            table.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        finally:
            batch.unpersist()

    return write


def latest_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_into`` keeps."""
    return spark.read.parquet(path).drop("bucket")


def session_stream(df: DataFrame, user: str, time: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """``series.sessions`` on a stream: a session comes out, once, when the watermark has passed its end; rows that come
    late but before that are merged, also where they join two sessions into one. Later rows are dropped."""
    own = df.withWatermark(time, delay).groupBy(user, F.session_window(time, gap).alias("w"))
    return own.agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("started"), F.max(time).alias("ended")).drop("w")


def stateful_baseline(df: DataFrame, key: str, time: str, value: str, baseline: int = 30, threshold: float = 2.0) -> DataFrame:
    """Points far from the last ``baseline`` ones of their key, which are kept as state: key, time, value, z.

    Points must come in order within a key, batch by batch; within a batch they are sorted.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).dropna(subset=[value]).sort_values(time)
        out = []
        for at, x in zip(rows[time], rows[value], strict=True):
            if len(past) >= LEAST_BASELINE:
                s = pd.Series(past).std()
                if s > 0 and abs(z := (x - sum(past) / len(past)) / s) >= threshold:
                    out.append((k[0], at, x, z))
            past = [*past, float(x)][-baseline:]
        state.update((past,))
        yield pd.DataFrame(out, columns=[key, time, value, "z"])

    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {time} {kinds[time]}, {value} {kinds[value]}, z double"
    return df.select(key, time, value).groupBy(key).applyInPandasWithState(step, schema, "past array<double>", "append", GroupStateTimeout.NoTimeout)


def once(items: DataFrame, fired: DataFrame, key: str) -> DataFrame:
    """Triggers that have not fired before."""
    return items.dropDuplicates([key]).join(fired.select(key), key, "left_anti")


def run_phases(phases: list[tuple[str, Callable[[], None]]], start_from: str | None = None, retries: int = 3, wait: float = 0.0, state: str | None = None) -> list[str]:
    """Run phases in order, each once, with retries; the names of those done. Stops at a phase that keeps failing.

    Between tries it waits ``wait`` seconds, then twice as long each time. A file ``state`` keeps what is done and the
    error that stopped it: a run that finds one goes on after the phases that it names, one that ends removes it.
    """
    names = [n for n, _ in phases]
    kept = Path(state) if state else None
    done: list[str] = json.loads(kept.read_text())["done"] if kept and kept.exists() and start_from is None else []
    before = set(names[: names.index(start_from)] if start_from else done)

    def note(error: str | None = None) -> None:
        if kept:
            kept.write_text(json.dumps({"done": done, "error": error}))

    for name, phase in phases:
        if name in before:
            continue
        for turn in range(retries):
            try:
                phase()
                done.append(name)
                note()
                break
            except Exception as e:
                if turn == retries - 1:
                    note(f"{name}: {e}")
                    raise
                time.sleep(wait * 2**turn)
    if kept:
        kept.unlink(missing_ok=True)
    return done


__all__ = ["StreamingQuery", "daily_counts", "deduplicated", "drain", "file_stream", "latest_table", "once", "run_phases", "session_stream", "stateful_baseline", "upsert_into"]
