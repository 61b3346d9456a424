"""Raw rows with JSON inside string columns, to trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.schema import MESSAGES, METADATA, blank, strip

_NO_CONTENT = "array<struct<type:string,text:string,index:int>>"
_NO_CALLS = "array<struct<function:struct<name:string,arguments:struct<status:string>>>>"
VARIANTS = (("android_control", "android-control"), ("aitw", "aitw"), ("coat", "coat"), ("guide", "guide"))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _content(m: Column) -> Column:
    return F.coalesce(m["content"], _empty(_NO_CONTENT))


def _calls(m: Column) -> Column:
    return F.coalesce(m["tool_calls"], _empty(_NO_CALLS))


def instruction(messages: Column) -> Column:
    """The first non-blank text of a user message, stripped; null if there is none."""
    parts = F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == "user"), _content))
    return strip(F.get(F.filter(parts, lambda c: (c["type"] == "text") & ~blank(c["text"])), F.lit(0))["text"])


def actions(messages: Column) -> Column:
    """Per assistant message: each named call but ``terminate`` (with the first description), else the description."""

    def one(m: Column) -> Column:
        said = strip(F.get(F.filter(_content(m), lambda c: c["type"] == "action_description"), F.lit(0))["text"])
        names = F.filter(F.transform(_calls(m), lambda t: t["function"]["name"]), lambda n: ~blank(n) & (n != "terminate"))
        full = F.transform(names, lambda n: F.when(blank(said), n).otherwise(F.concat(n, F.lit(": "), said)))
        return F.when(F.size(full) > 0, full).when(~blank(said), F.array(said)).otherwise(_empty("array<string>"))

    return F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), one))


def success(messages: Column) -> Column:
    """Whether the last ``terminate`` of any role says success; true if there is none, false if it has no status."""
    ends = F.filter(F.flatten(F.transform(messages, _calls)), lambda t: t["function"]["name"] == "terminate")
    last = F.get(ends, F.size(ends) - 1)["function"]["arguments"]["status"]
    return F.when(F.size(ends) == 0, F.lit(True)).otherwise(F.coalesce(F.lower(last), F.lit("")) == "success")


def image_count(messages: Column) -> Column:
    """The highest image index plus one if any has an index, else the number of images."""
    images = F.filter(F.flatten(F.transform(messages, _content)), lambda c: c["type"] == "image")
    top = F.array_max(F.transform(images, lambda c: c["index"]))
    return F.when(top.isNotNull(), top + 1).otherwise(F.size(images))


def variant(trajectory_id: Column) -> Column:
    out = F.lit("mobile-gui")
    for needle, name in reversed(VARIANTS):
        out = F.when(F.contains(F.lower(trajectory_id), F.lit(needle)), F.lit(name)).otherwise(out)
    return out


def embedding_text(instruction_: Column, app: Column, steps: Column) -> Column:
    """What an embedding model reads."""
    return F.concat(F.lit("Task: "), instruction_, F.lit(". App: "), app, F.lit(". Steps: "), F.array_join(steps, " "))


def parse_rows(raw: DataFrame) -> DataFrame:
    """``raw(row_idx, messages, metadata, imageCount)`` to trajectory columns without embedding; a null instruction marks a row that cannot be used."""
    m, meta = F.coalesce(F.from_json("messages", MESSAGES), F.array().cast(MESSAGES.simpleString())), F.from_json("metadata", METADATA)
    df = raw.withColumn("_m", m).withColumn("_d", meta)
    pick = lambda value, fallback: F.when(blank(value), fallback).otherwise(value)
    df = df.withColumn("id", pick(F.col("_d.others.id"), F.concat(F.lit("aguvis-row-"), F.col("row_idx").cast("string"))))
    return df.select(
        "id", instruction(F.col("_m")).alias("instruction"), pick(F.col("_d.platform"), F.lit("mobile")).alias("platform"), variant(F.col("id")).alias("app"), success(F.col("_m")).alias("success"), actions(F.col("_m")).alias("actions"),
        pick(F.col("_d.others.source"), F.lit("cua-lite/Aguvis")).alias("source"), pick(F.col("_d.others.source_id"), F.col("id")).alias("sourceId"), (F.col("imageCount") if "imageCount" in raw.columns else image_count(F.col("_m"))).cast("int").alias("imageCount"),
    )
