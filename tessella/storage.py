"""The folder that driver and executors share, and numbered tables in it."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of spark.checkpoint.dir; where it is unset, a local master gets a temporary folder and others an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = kept.get() if kept.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessella-shared-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where if "://" in where or where.startswith("file:") else f"file://{os.path.abspath(where)}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_WRITTEN: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = fresh_path(spark, tag)
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone already
            return


class Numbered:
    """Tables of a folder, one for each batch number; a batch that is run again overwrites its own."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, df: DataFrame, number: int) -> DataFrame:
        path = f"{self.folder}/{number}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def read(self, spark: SparkSession, numbers: list[int], schema) -> DataFrame:
        if not numbers:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in numbers])
