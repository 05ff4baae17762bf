"""Parquet table access and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the engine's tables below `base` (a file or a folder of part files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: the cluster's spark.checkpoint.dir. Where that is unset, a temporary one, in
    local mode only: on a cluster each machine would write to and read from a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="reqloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Written tables of one query. A table replaces lineage: a lost executor costs a re-read, not a recomputation.

    `save(df)` writes and reads back; `drop(df)` removes a table that no later step reads. What is left is removed
    when the Spark application ends, or before by `drop_written` once all results are consumed.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/reqloom-{uuid.uuid4().hex}"
        self.n = 0
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))
        spark.sparkContext.__dict__.setdefault("_reqloom_written", []).append(self.root)
        self._where: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        where = f"{self.root}/{self.n}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._where[id(out)] = where
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            where = self._where.pop(id(df), None)
            if where:
                self._fs.delete(self._path(where), True)


def drop_written(spark: SparkSession) -> int:
    """Removes the written tables of all queries so far, for long sessions; results that are still to be read need them, so
    first write or collect those. Returns how many queries' folders were there."""
    roots, gone = spark.sparkContext.__dict__.pop("_reqloom_written", []), 0
    jvm = spark.sparkContext._jvm
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone
