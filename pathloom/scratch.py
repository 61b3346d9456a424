"""Intermediate tables in the folder that driver and executors share.

Long jobs cut their lineage here: a lost executor then costs one stage, not the whole history. The folder is
``spark.checkpoint.dir``; only a session in local mode without one (tests, notebooks) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written, Spark deletes the job's shuffle files once it is done, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Without one a local session gets a temporary folder; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/pathloom-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with options of the writer, and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a kept table that nothing will read again."""
    mine = f"/pathloom-{df.sparkSession.sparkContext.applicationId}/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if mine in f}:
        _delete(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Delete every table kept by this application; frames that still read them become invalid."""
    _delete(spark, shared_dir(spark))


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer splits than cores over all cores; larger inputs keep their own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
