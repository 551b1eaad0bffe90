"""Tables written in the shared folder of the cluster, to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and all runs in one process on one machine (tests), a folder is made and set, so that all tables
    of a session share it. On a cluster executors could not read such a folder: there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of what is written and read no more.

    Spark deletes them once the driver has collected their plans. Results don't depend on it; without it a long chain of
    steps keeps the shuffles of all of them on disk until memory runs short. What Python lets go of reaches the driver
    after the first round, so there are two.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


#: For rows of megabytes: the writer looks at the size of its row group and pages after each row, not after 100. A reader
#: takes no batch beyond a row group, so neither holds more of them the more rows a task has. Statistics would keep the
#: least and greatest binary of each row group, whole, until the file is closed.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.column.statistics.enabled": "false"}


def table(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later failures restart from these files.

    ``drop`` deletes it once no later step reads it; what a result still reads goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(LARGE_ROWS if large_rows else {})).parquet(path)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """``table`` in buckets by a key, sorted in each, so that joins on the key need no shuffle of it; and what deletes
    it. The catalogue knows it by a name of its own until then; its files are in the shared folder too."""
    spark = df.sparkSession
    own = f"quillon_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quillon/{own}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(own)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)

    def forget() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {own}")
        files.delete(target, True)

    return spark.table(own), forget


def drop(*frames: DataFrame) -> None:
    """Delete tables that ``table`` wrote and that no later result reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/quillon/" in path:
                files, target = _file_system(spark, path)
                files.delete(target, True)


def unused(columns: list[str], name: str) -> str:
    """``name``, with marks before it until no column has it (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
