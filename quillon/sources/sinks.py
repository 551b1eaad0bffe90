"""Parquet export by month, with rows without a date apart, and without touching other months."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class ExportResult:
    written: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


def export_dated(df: DataFrame, date_col: str, path: str) -> None:
    """year=YYYY/month=MM from the first seven characters of the date text; months not in ``df`` stay as they are.

    Rows without a date go to undated/ beside them; rows whose date has fewer than seven characters are left out.
    """
    month = F.substring(F.col(date_col).cast("string"), 1, 7)
    dated = df.withColumn("year", F.substring(month, 1, 4)).withColumn("month", F.substring(month, 6, 2))
    # A month goes to few files, and a month too large for one task to several.
    dated = dated.where(F.length(month) == 7).hint("rebalance", "year", "month")
    dated.write.partitionBy("year", "month").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").parquet(f"{path}/dated")
    df.where(F.col(date_col).isNull()).write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/undated")


def export_plain(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def export_all(tables: dict[str, tuple[DataFrame, str | None]], path: str) -> ExportResult:
    """Export tables (frame, date column or None); a table that fails is noted and the others go on."""
    out = ExportResult()
    for name, (df, date_col) in tables.items():
        try:
            if date_col:
                export_dated(df, date_col, f"{path}/{name}")
            else:
                export_plain(df, f"{path}/{name}")
            out.written.append(name)
        except Exception as e:  # noqa: BLE001  the export of the other tables must go on
            out.errors[name] = str(e)
    return out


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside the old one and put it in its place once it is whole; a write that fails leaves the old one.

    ``df`` may read the table that it replaces. Readers see the old rows or the new ones, and for the moment between two
    renames none.
    """
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    try:
        df.write.option("compression", "snappy").parquet(new)
    except Exception:
        files.delete(at(new), True)
        raise
    if files.exists(at(path)) and not files.rename(at(path), at(old)):
        files.delete(at(new), True)
        raise OSError(f"{path} could not be moved")
    if not files.rename(at(new), at(path)):
        files.rename(at(old), at(path))
        raise OSError(f"{new} could not be moved to {path}")
    files.delete(at(old), True)


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Replace several tables at once: all are written into a new folder, whole, and one rename of a file that names it
    shows them. The version's name. A table that fails leaves all tables as they were.

    ``tables`` may read what they replace, and tables that are not among them stay published. Readers take
    ``published``; versions before the last are kept for those who still read them, until ``vacuum``.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    files, at = _files(spark, path)
    before = _listed(spark, path)
    try:
        for name, df in tables.items():
            df.write.option("compression", "snappy").parquet(f"{path}/{version}/{name}")
    except Exception:
        files.delete(at(f"{path}/{version}"), True)
        raise
    named = before | {name: f"{version}/{name}" for name in tables}
    stream = files.create(at(f"{path}/{version}.tmp"))
    stream.write(bytearray(json.dumps(named).encode()))
    stream.close()
    if not files.rename(at(f"{path}/{version}.tmp"), at(f"{path}/{version}.published")):
        files.delete(at(f"{path}/{version}"), True)
        raise OSError(f"{version} could not be published")
    return version


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as it was last published."""
    return spark.read.parquet(f"{path}/{_listed(spark, path)[name]}")


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the versions that no table of the last publication comes from."""
    used, (files, at) = {where.partition("/")[0] for where in _listed(spark, path).values()}, _files(spark, path)
    last = max(_publications(spark, path), default="")
    for status in files.listStatus(at(path)):
        name = status.getPath().getName()
        if name.startswith("v") and name.partition(".")[0] not in used and name != last:
            files.delete(status.getPath(), True)


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _publications(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at(path))] if files.exists(at(path)) else []
    return [n for n in names if n.endswith(".published")]


def _listed(spark: SparkSession, path: str) -> dict[str, str]:
    """Where the published tables are, by name; one small file is read."""
    last = max(_publications(spark, path), default=None)
    return json.loads(spark.read.text(f"{path}/{last}", wholetext=True).first().value) if last else {}
