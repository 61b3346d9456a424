"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.scratch import forget, keep, spread  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters, as a class of a regular expression and as they are.
SPACE, SPACES = "\\x20\\x09-\\x0D", " \t\n\v\f\r"
#: Runs of anything else.
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of all ``names`` in both frames, null equal to null."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out

#: Rows of a join side (of a few numbers each, some 100 MB at most) up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def bounded(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if a count shows that it is small; else as it is, for a shuffle join."""
    return F.broadcast(side) if side.count() <= rows else side


def fresh(taken, *names: str) -> list[str]:
    """Column names that none of ``taken`` has (in any case), made from ``names``."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


#: A key with over this share of all rows is hot; there are at most 1 / HOT of these.
HOT = 0.001


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and, in ``size``, how many of ``rows`` have that key.

    Hot keys are joined by broadcast (at most ``1 / HOT`` rows, whatever the input), so that none meets in one task; the
    rest by shuffle. Null keys are dropped. Both sides are read twice: give kept tables."""
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = table.where(F.col(size) > max(1.0, HOT * total))
    few = F.broadcast(hot)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(size) <= max(1.0, HOT * total)), keys)
    return cold.unionByName(rows.join(few, keys))


def labelled(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``docs`` that have a non-null label, with column ``y`` (of repeated labels the largest)."""
    one = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).cast("int").alias("y"))
    return docs.join(bounded(one), "doc_id")


def sampled(df: DataFrame, rows: int, *strata: str) -> DataFrame:
    """Of each stratum about ``rows`` rows, those with the lowest hash of doc_id, without moving texts; all of a smaller one.

    A count of each stratum gives the share of the hash range to keep, so no stratum meets in one task."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    share = bounded(df.groupBy(*strata).agg((F.lit(float(rows)) / F.count("*")).alias("_share")), 100_000)
    below = F.col("_h").cast("double") / 2.0**63 < 2 * F.col("_share") - 1
    return df.withColumn("_h", h).join(share, list(strata)).where(below | (F.col("_share") >= 1)).drop("_share", "_h")
