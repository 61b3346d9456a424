"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a join and an aggregation with partial combine, so a hub vertex never gathers its neighbours in one task,
and the number of rounds grows with the logarithm of the longest path rather than with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.scratch import keep


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """Return ``(id, root)``, one row for each vertex of ``edges``; ``root`` is the smallest id of its component.

    Loops, repeats and either direction of an edge are allowed; rows with a null end are ignored. Raises
    ``RuntimeError`` if ``max_rounds`` are not enough (a path of 2**60 vertices would be).
    """
    a, b = F.col(left), F.col(right)
    proper = edges.where(a.isNotNull() & b.isNotNull())
    loops = proper.where(a == b).select(a.alias("id"))
    stars = keep(proper.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        hooked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = keep(hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = stars.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    linked = stars.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
    alone = loops.distinct().join(linked, "id", "left_anti").select("id", F.col("id").alias("root"))
    return linked.unionByName(alone)
