"""Controlled failures: truncated copies of successful trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.sampling import even_sample

SOURCE, KIND = "controlled-failure-injection", "truncated"


def eligible(df: DataFrame) -> DataFrame:
    return df.where(F.col("success") & (F.size("actions") >= 3))


def truncated(df: DataFrame) -> DataFrame:
    """Each row cut to its first max(1, min(n - 1, 2n div 3)) actions and marked as a failure of its parent."""
    n = F.size("actions")
    kept = F.greatest(F.lit(1), F.least(n - 1, F.expr("(size(actions) * 2) div 3").cast("int")))
    new = {"id": F.concat("id", F.lit("-failed-truncated")), "success": F.lit(False), "actions": F.slice("actions", F.lit(1), kept), "source": F.lit(SOURCE), "sourceId": F.col("id"), "imageCount": F.lit(0)}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def parents_of(df: DataFrame, count: int = 57, labels: DataFrame | None = None, order: str = "id") -> DataFrame:
    """The rows to fail: every labelled id (all must be eligible), else an even sample in order of ``order``, a unique column:
    the place in the input where the input has one (a table has no order of its own), else the id."""
    can = eligible(df)
    if labels is None:
        return even_sample(can, count, order).drop("ordinal")
    ids = labels.select("id").distinct()
    missing = ids.join(can, "id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError("not eligible: " + ", ".join(r.id for r in missing))
    return can.join(ids, "id", "left_semi")


def alternatives(groups: DataFrame) -> DataFrame:
    """(id, alternative): other members of the id's retrieval group ``groups(label, id)``; an id in two groups is an error."""
    if groups.groupBy("id").agg(F.countDistinct("label").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("an id is in two retrieval groups")
    other = groups.select("label", F.col("id").alias("alternative"))
    return groups.join(other, "label").where("alternative <> id").select("id", "alternative").distinct()


def inject(df: DataFrame, count: int = 57, labels: DataFrame | None = None, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(all rows with the failures appended, pairs): pairs hold failureId, successfulId, alternatives and action counts."""
    parents = parents_of(df, count, labels, order)
    failed = truncated(parents)
    pairs = parents.select(F.concat("id", F.lit("-failed-truncated")).alias("failureId"), F.col("id").alias("successfulId"), F.size("actions").alias("originalActionCount"))
    pairs = pairs.join(failed.select(F.col("id").alias("failureId"), F.size("actions").alias("remainingActionCount")), "failureId").withColumn("failureType", F.lit(KIND))
    if labels is not None:
        lists = alternatives(labels).groupBy(F.col("id").alias("successfulId")).agg(F.array_sort(F.collect_list("alternative")).alias("alternativeSuccessfulIds"))
        pairs = pairs.join(lists, "successfulId", "left")
    else:
        pairs = pairs.withColumn("alternativeSuccessfulIds", F.lit(None).cast("array<string>"))
    return df.unionByName(failed), pairs.withColumn("alternativeSuccessfulIds", F.coalesce("alternativeSuccessfulIds", F.array().cast("array<string>")))
