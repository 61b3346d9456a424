"""Trajectory views of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources.parse import actions, instruction, success


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one row for each stored vector."""
    n = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        F.format_string("vec-%06d", n).alias("id"), F.when(n % 2 == 0, "mobile").otherwise("desktop").alias("platform"), F.concat(F.lit("app-"), (n % 3).cast("string")).alias("app"),
        (n % 5 != 0).alias("success"), F.col("label").cast("long").alias("intent"), "embedding",
    )


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one row for each document, successful unless its quality label says otherwise."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.format_string("doc-%06d", "doc_id").alias("id"), F.col("text").alias("instruction"), F.lit("mobile").alias("platform"), F.col("lang").alias("app"),
        F.coalesce(F.col("quality") == 1, F.lit(True)).alias("success"), F.array().cast("array<string>").alias("actions"), "source", "n_chars",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as one message list in the import format."""
    turn = F.struct(F.col("turn"), F.col("role"), F.array(F.struct(F.when(F.col("role") == "assistant", "action_description").otherwise("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("int").alias("index"))).alias("content"))
    calls = F.lit(None).cast("array<struct<function:struct<name:string,arguments:struct<status:string>>>>")
    lists = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), calls.alias("tool_calls"))).alias("m"))


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: one row for each conversation with a user turn that is not blank."""
    df = messages(spark, sf_dir).select(F.format_string("conv-%06d", "conv_id").alias("id"), instruction(F.col("m")).alias("instruction"), F.lit("mobile").alias("platform"), F.concat(F.lit("app-"), (F.col("conv_id") % 3).cast("string")).alias("app"), success(F.col("m")).alias("success"), actions(F.col("m")).alias("actions"), F.lit("local").alias("source"))
    return df.where("instruction is not null").withColumn("sourceId", F.col("id")).withColumn("imageCount", F.lit(0))
