"""Sinks: trajectory tables, one-file JSON for small outputs, failure pairs, reports, import summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_ROWS = 100_000


def write_trajectories(df: DataFrame, path: str) -> None:
    """Parquet, or JSON lines for a path that ends in ``.json``; the committer makes the result appear at once."""
    writer = df.write.mode("overwrite")
    writer.json(path) if path.endswith(".json") else writer.parquet(path)


def write_pretty(df: DataFrame, path: str) -> None:
    """One indented JSON array for people, written aside and then renamed over the former one in one step; over ``MAX_FILE_ROWS`` rows is an error."""
    rows = df.limit(MAX_FILE_ROWS + 1).toJSON().take(MAX_FILE_ROWS + 1)
    if len(rows) > MAX_FILE_ROWS:
        raise ValueError(f"over {MAX_FILE_ROWS} rows: use write_trajectories")
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = final.getFileSystem(conf)
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False).encode()))
    out.close()
    aside, final = fs.makeQualified(aside), fs.makeQualified(final)
    over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(over, 1)
    options[0] = over.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(aside, final, options)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row table as JSON, with the time it was made."""
    report.withColumn("generatedAt", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def pair_set(pairs: DataFrame, name: str, version: str, policy: str) -> DataFrame:
    """The failure pairs as one nested row (a pair set is bounded by its labels or its count)."""
    cols = ("failureId", "successfulId", "alternativeSuccessfulIds", "failureType", "originalActionCount", "remainingActionCount")
    rows = F.array_sort(F.collect_list(F.struct(*cols)))
    return pairs.agg(rows.alias("pairs")).select(F.lit(name).alias("name"), F.lit(version).alias("version"), F.current_timestamp().cast("string").alias("generatedAt"), F.lit(policy).alias("generationPolicy"), "pairs")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def import_summary(df: DataFrame) -> DataFrame:
    """(app, n, dimension) of what was imported."""
    return df.groupBy("app").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimension"))
