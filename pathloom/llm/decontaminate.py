"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``WINDOW`` consecutive words of an item (an item of fewer is one window). A window is a sequence of 3-word
shingles (of 1 or 2 words where the window is that short). Since containment must be exact, a document with the window
has *all* of its shingles, so the necessary prefix is one shingle: the rarest.

1. Documents' shingles (hashes with positions) meet the benchmark's distinct shingles; what matches is kept: it tells
   how rare each shingle is, and a window with a shingle that matched nowhere occurs nowhere.
2. Each window joins the matches of its rarest shingle only; the shingle's place in the window gives the start, and the
   length and position bounds (0 <= start, start + length <= words) prune.
3. Documents with candidates are read again and each window is compared word by word at its start.

The benchmark's shingles are broadcast in shares of ``SHARE``; a window that occurs in a third of all documents gives a row for each
occurrence, never a pair of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bounded, fresh, keep, same

WINDOW, SHINGLE = 10, 3
#: Shingles of the benchmark that are broadcast at once, about.
SHARE = 2_000_000
#: ASCII letters and digits, and whatever is beyond ASCII, make words; A-Z are lower-cased, the rest becomes spaces.
_OTHER = "".join(c for c in map(chr, range(128)) if not (c.isdigit() or c.islower()))
_FOLDED = "".join(c.lower() if c.isalpha() else " " for c in _OTHER)
#: Stands once for each document among its shingles, so that one pass also counts words.
DOCUMENT = -7046029254386353131


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _OTHER, _FOLDED), " "), "")


def _shingles(words: Column, q: int) -> Column:
    """Hashes of each run of ``q`` words; empty where there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (q - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(words, (i + k).cast("int")) for k in range(q)])))
    return F.when(F.size(words) >= q, runs).otherwise(F.array().cast("array<long>"))


def windows_of(benchmark: DataFrame) -> DataFrame:
    """item_id, win (words joined by a space), len; an item without words has none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    runs = F.transform(starts, lambda i: F.slice("w", i.cast("int"), WINDOW))
    return items.select("item_id", F.explode(runs).alias("r")).select("item_id", F.array_join("r", " ").alias("win"), F.size("r").alias("len")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words; repeated rows (same id and text) get the same answer each; items with a null id
    hit words but are not listed; with an empty benchmark nothing is hit.
    """
    return _verdicts(docs, benchmark).drop("mark")


def _verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with mark, the hash of the row's text."""
    mark = F.xxhash64("text").alias("mark")
    windows = keep(windows_of(benchmark))
    distinct = windows.select("win", "len").distinct()
    q = F.least(F.col("len"), F.lit(SHINGLE))
    parts = distinct.select("win", "len", q.alias("q"), F.split("win", " ").alias("w"))
    sizes = sorted(r.q for r in parts.select("q").distinct().collect())  # of 1, 2, 3
    choose = F.lit(None).cast("array<long>")
    for n in sizes:
        choose = F.when(F.col("q") == n, _shingles(F.col("w"), n)).otherwise(choose)
    parts = keep(parts.select("win", "len", "q", F.posexplode(choose).alias("at", "sh")))
    spark = docs.sparkSession
    known = keep(parts.select("q", "sh").unionByName(spark.createDataFrame([(0, DOCUMENT)], "q int, sh long")).distinct())
    shares = max(1, -(-known.count() // SHARE))  # a large benchmark is met share by share, so that no shingle of a document is shuffled
    words = docs.select("doc_id", mark, F.coalesce(words_of(F.col("text")), F.array().cast("array<string>")).alias("w"))
    found = None
    for n in sizes:
        every = _shingles(F.col("w"), n) if found is not None else F.concat(_shingles(F.col("w"), n), F.array(F.lit(DOCUMENT)))
        each = words.select("doc_id", "mark", F.size("w").alias("n"), F.posexplode(every).alias("pos", "sh"))
        for k in range(shares):
            share = known.where(F.col("q").isin(n, 0)).where(F.pmod("sh", F.lit(shares)) == k)
            got = each.join(F.broadcast(share), "sh")
            found = got if found is None else found.unionByName(got)
    none = F.sha2(F.lit(""), 256)
    if found is None:
        counted = words.select("doc_id", "mark", F.size("w").cast("long").alias("n_words"))
        return counted.select("doc_id", "mark", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    found = keep(found)
    counted = found.where("q = 0").select("doc_id", "mark", F.col("n").cast("long").alias("n_words"))
    found = found.where("q > 0")
    rarity = found.groupBy("q", "sh").agg(F.count("*").alias("seen"))
    prefix = parts.join(rarity, ["q", "sh"], "left").groupBy("win", "len", "q").agg(F.min(F.coalesce("seen", F.lit(0))).alias("least"), F.min_by(F.struct("sh", "at"), F.struct(F.coalesce("seen", F.lit(0)), "at")).alias("p"))
    prefix = prefix.where("least > 0").select("win", "len", "q", "p.sh", "p.at")
    near = found.join(prefix, ["q", "sh"]).withColumn("start", F.col("pos") - F.col("at")).where("start >= 0 and start + len <= n")
    near = keep(near.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "len", "win")).alias("near")))
    small = bounded(near.select("doc_id", "mark"))
    again = docs.select("doc_id", "text", mark)
    again = again.join(small, same(again, small, "doc_id", "mark"), "left_semi").dropDuplicates(["doc_id", "mark"])
    again = again.select("doc_id", "mark", words_of(F.col("text")).alias("w"))
    both = again.join(near, same(again, near, "doc_id", "mark")).select(again["doc_id"], again["mark"], "w", "near")
    hits = F.filter("near", lambda x: F.array_join(F.slice("w", x["start"] + 1, x["len"]), " ") == x["win"])
    hits = keep(both.select("doc_id", "mark", hits.alias("hits")).where(F.size("hits") > 0))
    spots = F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
    n_hit = hits.select("doc_id", "mark", F.size(F.array_distinct(spots)).cast("long").alias("n_hit"))
    items = hits.select("doc_id", "mark", F.explode(F.array_distinct(F.transform("hits", lambda x: x["win"]))).alias("win"))
    items = items.join(windows.select("win", F.col("item_id").cast("string").alias("item")), "win").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    verdict = n_hit.join(items, same(n_hit, items, "doc_id", "mark")).select(n_hit["doc_id"], n_hit["mark"], "n_hit", "items")
    out = counted.join(verdict, same(counted, verdict, "doc_id", "mark"), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(counted["doc_id"], counted["mark"], "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs; rows that share a doc_id are told apart by text."""
    (mark,) = fresh(docs.columns, "_text_mark")
    bad = _verdicts(docs, benchmark).where("contaminated").select("doc_id", F.col("mark").alias(mark)).distinct()
    rows = docs.withColumn(mark, F.xxhash64("text"))
    return rows.join(bad, same(rows, bad, "doc_id", mark), "left_anti").drop(mark)
