"""Tables written between the rounds of an iteration, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and all runs in one process on one machine, one is made and
    set; on a cluster executors could not read such a folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _files(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: its lineage ends here, and a lost executor costs only its running tasks. What no
    later step reads goes by ``discard``, the rest when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _files(spark, path)
    files.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/quillon-rounds/" in path:
                files, target = _files(df.sparkSession, path)
                files.delete(target, True)
