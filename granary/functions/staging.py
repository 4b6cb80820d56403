"""Intermediate tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 250_000  # rows of a part that ``dealt`` makes

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode; on a cluster that is an error, since
    a folder of one machine would not be seen by the others.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="granary-"))


def staged(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, so a lost executor
    costs one stage at most, and the planner knows the table's size when it chooses a join.

    release: asks the JVM to collect garbage, so that Spark removes the shuffle files of what has just
    been written; worth it after large shuffles only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark, path = df.sparkSession, df._staged_at
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """At least a partition for each core: for a small table whose rows are about to become many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Repartitioned by ``keys`` into as many parts as there are cores, or more where a part would hold over ``TASK_ROWS`` of its some
    ``rows`` rows: a task's memory stays what it is however large the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1), *keys)
