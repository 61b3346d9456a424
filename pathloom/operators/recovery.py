"""Failure recovery: does a search from a failed trajectory find its successful parent, and other successes?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.knn import MAX_K, check_k, knn_join, without
from pathloom.operators.metrics import retrieval_per_query


def problems(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rule, failureId) for each pair that the table contradicts."""
    fail = df.select(F.col("id").alias("failureId"), F.col("success").alias("f_ok"), F.col("sourceId").alias("f_from"))
    good = df.select(F.col("id").alias("successfulId"), F.col("success").alias("s_ok"))
    both = pairs.select("failureId", "successfulId").join(fail, "failureId", "left").join(good, "successfulId", "left")
    rules = [("missing failure", F.col("f_ok").isNull()), ("missing parent", F.col("s_ok").isNull()), ("failure succeeded", F.col("f_ok")), ("parent failed", ~F.col("s_ok")), ("wrong parent", F.col("f_from") != F.col("successfulId"))]
    each = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    return both.select(F.explode(each).alias("rule"), "failureId")


def recovery_per_failure(df: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """failureId, parent_rank (in the k + 1 raw results, 0: absent), then metrics of the alternatives without the parent.

    Searches run among successes of the failure's platform and app. ``pairs`` has failureId, successfulId and the array
    alternativeSuccessfulIds."""
    failed = df.join(pairs.select(F.col("failureId").alias("id"), "successfulId"), "id").select(F.col("id").alias("qid"), "embedding", "platform", "app", "successfulId")
    raw = knn_join(failed.drop("successfulId"), df.where("success"), ("platform", "app"), min(MAX_K, check_k(k) + 1))
    raw = raw.join(failed.select("qid", "successfulId"), "qid")
    parent = raw.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("id") == F.col("successfulId"), F.col("rank"))), F.lit(0)).cast("long").alias("parent_rank"))
    rest = without(raw, F.col("id") == F.col("successfulId"), k)
    want = pairs.select(F.col("failureId").alias("qid"), F.explode_outer("alternativeSuccessfulIds").alias("id"))
    metrics = retrieval_per_query(rest, want, k)
    out = pairs.select(F.col("failureId").alias("qid")).join(parent, "qid", "left").join(metrics, "qid", "left").fillna(0)
    return out.withColumnRenamed("qid", "failureId")


def recovery_summary(per_failure: DataFrame, k: int = 5) -> DataFrame:
    """One row: parent recall at 1 and k over all, the rest over failures that have alternatives."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    some = F.col("relevant") > 0
    r = F.col("parent_rank")
    return per_failure.agg(
        F.count("*").alias("failures"), mean((r == 1).cast("double")).alias("parent_recall_1"), mean(((r > 0) & (r <= k)).cast("double")).alias("parent_recall_k"),
        mean(F.when(some, F.col("recall"))).alias("recall"), mean(F.when(some, (F.col("hits") > 0).cast("double"))).alias("hit_rate"), mean(F.when(some, F.col("rr"))).alias("mrr"),
    )


def hardest(per_failure: DataFrame, n: int = 15) -> DataFrame:
    """Failures whose first alternative ranks worst (none at all is worst), ties by id."""
    worst = F.when(F.col("first_rank") == 0, F.lit(2147483647)).otherwise(F.col("first_rank"))
    return per_failure.where("relevant > 0").orderBy(F.desc(worst), "failureId").limit(n)
