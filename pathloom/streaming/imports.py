"""Resumable import: raw rows stream into Parquet, a checkpoint after each micro-batch.

A second run with the same folders goes on where the first stopped; exactly-once by the file sink's own log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources import paged
from pathloom.sources.parse import parse_rows


def import_rows(spark: SparkSession, out: str, checkpoint: str, **options) -> DataFrame:
    """Fetch until the limit is reached, then return the raw rows written so far. See ``paged.RowService`` for options."""
    paged.register(spark)
    rows = spark.readStream.format("pathloom_rows").options(**{k: str(v) for k, v in options.items()}).load()
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(paged.SCHEMA).parquet(out)


def parsed_stream(stream: DataFrame) -> DataFrame:
    """The parser over a stream of raw rows; rows without an instruction are left out."""
    return parse_rows(stream).where("instruction is not null")


def counts_by_app(stream: DataFrame) -> DataFrame:
    """Running counts for each app of parsed rows (output mode complete or update)."""
    return stream.groupBy("app").agg(F.count("*").alias("n"))
