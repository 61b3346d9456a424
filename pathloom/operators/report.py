"""Counts and one-row reports, written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) for each of ``columns``, in one pass over the table."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    bit = {c: len(columns) - 1 - i for i, c in enumerate(columns)}
    field = F.coalesce(*[F.when(F.col("g").bitwiseAND(F.lit(1 << b).cast("long")) == 0, F.lit(c)) for c, b in bit.items()])
    value = F.coalesce(*[F.when(F.col("g").bitwiseAND(F.lit(1 << b).cast("long")) == 0, F.col(c).cast("string")) for c, b in bit.items()])
    return sets.select(field.alias("field"), value.alias("value"), "n")


def model_name(dimension: int) -> str:
    return "MiniLM" if dimension == 384 else "feature-hash"


def dataset_report(df: DataFrame) -> DataFrame:
    """One row: trajectories, dimension, model, successes, images, apps, sources."""
    dim = F.coalesce(F.max(F.size("embedding")), F.lit(0))
    return df.agg(F.count("*").alias("trajectories"), dim.cast("long").alias("dimension"), F.when(dim == 384, "MiniLM").otherwise("feature-hash").alias("model"), F.count_if(F.col("success")).alias("successes"), F.coalesce(F.sum(F.col("imageCount").cast("long")), F.lit(0)).alias("images"), F.count_distinct("app").alias("apps"), F.count_distinct("source").alias("sources"))


def write_report(report: DataFrame, path: str) -> None:
    """A one-row table as JSON, with the time it was made."""
    report.withColumn("generatedAt", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)
