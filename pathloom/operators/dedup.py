"""Near-duplicate groups: k-nearest-neighbour edges over a threshold, their connected components, group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.vectors import norm
from pathloom.operators.components import connected_components
from pathloom.operators.knn import knn_join
from pathloom.scratch import keep

KEYS = ("platform", "app", "success")


def _check(threshold: float, candidates: int) -> None:
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must be -1 to 1")
    if not 2 <= candidates <= 100:
        raise ValueError("candidates must be 2 to 100")


def duplicate_edges(df: DataFrame, threshold: float = 0.985, candidates: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """(qid, id, cos): directed. The row itself takes one of the ``candidates`` places; the threshold compares floats."""
    _check(threshold, candidates)
    near = knn_join(df.withColumnRenamed("id", "qid"), df, keys, candidates, least=threshold)
    return near.where((F.col("id") != F.col("qid")) & (F.col("cos") >= F.lit(threshold).cast("float"))).select("qid", "id", "cos")


def group_means(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(root, mean_cos): mean cosine over all pairs of a group, without making pairs: (|sum of units|**2 - units) / (n (n - 1))."""
    unit = vectors.select("id", F.col("embedding").alias("v"), norm(F.col("embedding")).alias("len"))
    unit = unit.select("id", F.transform("v", lambda x: F.when(F.col("len") > 0, x.cast("double") / F.col("len")).otherwise(0.0)).alias("u"), (F.col("len") > 0).cast("int").alias("some"))
    rows = members.join(unit, "id")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum("some").alias("units"))
    sums = rows.select("root", F.posexplode("u").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("s"))
    square = sums.groupBy("root").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    mean = (F.col("sq") - F.col("units")) / (F.col("n") * (F.col("n") - 1))
    return sizes.join(square, "root").select("root", mean.cast("float").alias("mean_cos"))


def duplicate_members(df: DataFrame, threshold: float = 0.985, candidates: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """(id, root) of every row in a group of two or more; root is the group's smallest id."""
    return connected_components(keep(duplicate_edges(df, threshold, candidates, keys)), "qid", "id")


def duplicate_groups(df: DataFrame, threshold: float = 0.985, candidates: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """(canonical_id, member_ids sorted, mean_cos)."""
    members = duplicate_members(df, threshold, candidates, keys)
    lists = members.groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("member_ids"))
    return lists.join(group_means(members, df), "root").select(F.col("root").alias("canonical_id"), "member_ids", "mean_cos")


def first_groups(groups: DataFrame, n: int = 10) -> DataFrame:
    """One row: the first ``n`` groups by canonical id, as a list."""
    some = groups.orderBy("canonical_id").limit(n)
    return some.agg(F.array_sort(F.collect_list(F.struct("canonical_id", "member_ids", "mean_cos"))).alias("first_groups"))


def group_stats(members: DataFrame) -> DataFrame:
    """One row: groups, members, largest."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), zero).alias("members"), F.coalesce(F.max("n"), zero).alias("largest"))
