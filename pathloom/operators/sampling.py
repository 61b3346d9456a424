"""Deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """Place of each row by the unique column ``order``, from 0, without sorting all rows in one task: places within
    range partitions plus what the partitions before hold."""
    cut = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism * 2, order).withColumn("_part", F.spark_partition_id())
    from pathloom.scratch import keep

    cut = keep(cut)
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return cut.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def even_sample(df: DataFrame, count: int, order: str = "id") -> DataFrame:
    """Rows at places floor(i * n / count) in order of ``order``; more than there are rows is an error."""
    if not 1 <= count <= 500:
        raise ValueError("count must be 1 to 500")
    n = df.count()
    if count > n:
        raise ValueError(f"{count} rows wanted, {n} there")
    places = df.sparkSession.range(count).select(F.expr(f"(id * {n}L) div {count}").alias("index"), F.col("id").alias("ordinal"))
    return indexed(df, order).join(F.broadcast(places), "index").drop("index")


def seeded_sample(df: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``count`` rows (1 to 10,000) in an order that depends on id and seed only."""
    if not 1 <= count <= 10_000:
        raise ValueError("count must be 1 to 10000")
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count)
