"""Mix sources to target weights: packed blocks, drawn shards, permuted indices, a join by block index.

1. Each source's words form one stream, its documents in a pseudorandom order, cut into blocks of ``block`` words.
2. Targets: the sources share ``share`` times all words by weight; none gets over ``cap`` times its own words.
3. A source fills as many block slots as its target needs. Output shards of ``shard`` slots draw how many of their slots
   each source gets: a multinomial draw, conditioned on the sources' totals so that targets are met to the word. The
   draw walks down a binary tree of shards, so each shard finds its counts and its place in every source without
   hearing of the others.
4. A source's n-th slot takes block perm(n mod blocks), perm being a keyed Feistel permutation, another for each epoch.
5. Slots and documents meet in a join on (source, block).

Only sizes, never texts, take part in the plan (1 to 5): texts are read once more, for the join with the stretches that the
mix takes of them. One row per source reaches the driver and the workers. Rows that repeat a document are one row with a
number of copies until each copy gets its own place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import SPACE, SPACES, WORD, bounded, keep, same, spread

#: Rows in a bucket of a source, about; buckets of a source, at least; copies that one task lists.
BUCKET, BUCKETS, COPIES = 4096, 1024, 10_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last: int  #: words taken from the block of the last slot


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets by weight, capped at ``cap`` times a size, the excess reshared by weight until none is above its cap."""
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of range(n): a Feistel network over the next even power of two, walked until inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask, keys = np.uint64((1 << int(half)) - 1), _mix64(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = np.array(index, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> half, out[todo] & mask
        for k in keys:
            a, b = b, a ^ (_mix64(b + k) & mask)
        out[todo] = (a << half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(seed: int, source: int, epoch: int) -> int:
    return (seed * 1_000_003 + source) * 1_000_003 + epoch


def _slots(size: int, target: float, block: int, key_of) -> tuple[int, int, int]:
    """Blocks of a source, its number of slots, and the words its last slot takes."""
    want, blocks = int(target + 0.5), -(-size // block)
    if not want or not size:
        return blocks, 0, 0
    epochs, rest = divmod(want, size)
    if not rest:
        order_last = _last_block_at(blocks, key_of(epochs - 1))
        return blocks, epochs * blocks, block if order_last != blocks - 1 else size - (blocks - 1) * block
    short = size - (blocks - 1) * block
    more, at = -(-rest // block), _last_block_at(blocks, key_of(epochs))
    if at < more:
        more = -(-(rest + block - short) // block)
    before = (more - 1) * block - (block - short if at < more - 1 else 0)
    return blocks, epochs * blocks + more, rest - before


def _last_block_at(blocks: int, key: int) -> int:
    """The position of the short last block: walk the permutation's cycle that leads to it."""
    half = max(1, (max(blocks - 1, 1).bit_length() + 1) // 2)
    mask, keys = (1 << half) - 1, _mix64(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    x = blocks - 1
    while True:
        a, b = x >> half, x & mask
        for k in keys[::-1]:
            a, b = b ^ (int(_mix64(np.array([a], np.uint64) + k)[0]) & mask), a
        x = (a << half) | b
        if x < blocks:
            return x


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` drawn without replacement are among ``good``. Numpy draws up to 10**9; beyond, the same law exactly:
    X ~ Bin(n, p) and Y ~ Bin(rest, p) given that X + Y = good. The pairs are drawn in batches until one fits."""
    if not n or not good:
        return 0
    if not bad or n == good + bad:
        return min(n, good)
    if good < 1_000_000_000 and bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    return conditioned(good, bad, n, rng)


def conditioned(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    p, size = good / (good + bad), 1024
    while True:
        x = rng.binomial(n, p, size)
        fits = np.flatnonzero(x + rng.binomial(good + bad - n, p, size) == good)
        if len(fits):
            return int(x[fits[0]])
        size = min(2 * size, 1 << 18)


def _draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric: how many of n slots go to each source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = hypergeometric(c, rest, n, rng)
        n -= int(out[i])
    return out


def shard_counts(slots: np.ndarray, shard: int, k: int, seed: int, drawn: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of shard ``k``: each source's slots, and how many it has in earlier shards. ``drawn`` keeps the draws on the way."""
    drawn = {} if drawn is None else drawn
    counts, total = np.asarray(slots, dtype=np.int64), int(np.sum(slots))
    lo, hi, before = 0, -(-total // shard), np.zeros(len(slots), dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (lo, hi) not in drawn:
            drawn[lo, hi] = _draw(counts, mid * shard - lo * shard, np.random.default_rng([seed, lo, hi]))
        left = drawn[lo, hi]
        if k < mid:
            counts, hi = left, mid
        else:
            before, counts, lo = before + left, counts - left, mid
    return counts, before


class Mix:
    """A plan for one corpus. Null sources form a source of their own (last), null texts have no words, equal rows are
    interchangeable and each has its own share; an empty table gives empty results. Other columns are left alone."""

    def __init__(self, docs: DataFrame, weights=(3, 1, 2), share=1.5, cap=2.0, block=256, shard=1024, seed=17):
        self.docs, self.spark, self.block, self.shard, self.seed = docs, docs.sparkSession, block, shard, seed
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("mark"))
        sized = keep(sized.groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("copies")))
        sums = F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("n"), F.max("copies").alias("copies")
        rows = sized.groupBy("source").agg(*sums).collect()  # a row for each source
        rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
        self.most = max((r.copies for r in rows), default=1)
        goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, cap)
        self.sources = [Source(r.source, r["size"], t, *_slots(r["size"], t, block, lambda e, i=i: _key(seed, i, e))) for i, (r, t) in enumerate(zip(rows, goal, strict=True))]
        schema = "source_ix int, name string, source_size long, target double, buckets int"
        names = [(i, s.name, s.size, float(s.target), max(BUCKETS, r.n // BUCKET)) for i, (s, r) in enumerate(zip(self.sources, rows, strict=True))]
        names = bounded(self.spark.createDataFrame(names, schema))
        sized = sized.join(names, sized["source"].eqNullSafe(names["name"])).drop("name")
        sized = sized.withColumn("bucket", F.pmod(F.hash("mark"), F.col("buckets"))).withColumn("words", F.col("size") * F.col("copies"))
        before = sized.groupBy("source_ix", "bucket").agg(F.sum("words").alias("n"))
        before = before.select("source_ix", "bucket", (F.sum("n").over(Window.partitionBy("source_ix").orderBy("bucket")) - F.col("n")).alias("base"))
        inside = F.sum("words").over(Window.partitionBy("source_ix", "bucket").orderBy("mark", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
        placed = sized.withColumn("inside", inside).join(before, ["source_ix", "bucket"])
        start = F.when(F.col("size") > 0, F.col("base") + F.col("inside"))
        self.groups = keep(placed.select("doc_id", "source", "mark", "size", "copies", "source_ix", "source_size", "target", start.alias("start")))

    def placed(self) -> DataFrame:
        """A row for each document: copies stand one after the other; (source_ix, start) is unique where there are words."""
        rows, last = self.groups, F.col("copies") - 1
        if self.most > COPIES:  # no task lists all copies of one row
            first = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))).alias("_first")
            rows = rows.select("*", first).repartition(max(2, self.spark.sparkContext.defaultParallelism)).withColumn("_last", F.least(F.col("_first") + (COPIES - 1), last))
        else:
            rows = rows.withColumns({"_first": F.lit(0).cast("long"), "_last": last})
        rows = rows.withColumn("_nth", F.explode(F.sequence("_first", "_last")))
        return rows.withColumn("start", F.col("start") + F.col("_nth") * F.col("size")).drop("_first", "_last", "_nth", "copies")

    def slots(self) -> DataFrame:
        """Each slot of the output: shard, slot, source_ix, epoch, block, words."""
        sources, shard, seed, block = self.sources, self.shard, self.seed, self.block
        count = np.array([s.slots for s in sources], dtype=np.int64)
        schema = "shard long, slot int, source_ix int, epoch int, block long, words int"

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            drawn: dict = {}  # a task's shards follow each other: they share most of the way
            for part in parts:
                for k in part["id"].tolist():
                    if len(drawn) > 10_000:
                        drawn.clear()
                    mine, before = shard_counts(count, shard, k, seed, drawn)
                    out = []
                    for i in np.flatnonzero(mine).tolist():
                        s, nth = sources[i], np.arange(before[i], before[i] + mine[i])
                        epoch, at, ids = nth // s.blocks, nth % s.blocks, np.zeros(len(nth), np.int64)
                        for e in np.unique(epoch).tolist():
                            ids[epoch == e] = permute(at[epoch == e], s.blocks, _key(seed, i, e))
                        words = np.where(ids == s.blocks - 1, s.size - (s.blocks - 1) * block, block)
                        out.append(pd.DataFrame({"source_ix": i, "epoch": epoch, "block": ids, "words": np.where(nth == s.slots - 1, s.last, words)}))
                    got = pd.concat(out)
                    yield got.assign(shard=k, slot=np.random.default_rng([seed, 3, k]).permutation(len(got)))[["shard", "slot", "source_ix", "epoch", "block", "words"]]

        shards = -(-int(count.sum()) // shard)
        return self.spark.range(0, shards, 1, max(1, min(shards, 4 * self.spark.sparkContext.defaultParallelism))).mapInPandas(deal, schema)

    def pieces(self, *more: str) -> DataFrame:
        """Each stretch of a document in a block, once for each slot that takes it: ``at`` words into the document, ``n`` long."""
        b = self.block
        docs = self.placed().where("size > 0").select("source_ix", "start", "size", *more, F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
        docs = docs.select("source_ix", "start", *more, "block", F.greatest(F.col("start"), F.col("block") * b).alias("a"), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b).alias("z"))
        met = docs.join(self.slots().hint("merge"), ["source_ix", "block"])  # slots grow with the corpus: never broadcast
        end = F.least(F.col("z"), F.col("block") * b + F.col("words"))
        return met.select("source_ix", "start", *more, "shard", "slot", "epoch", "block", (F.col("a") - F.col("start")).alias("at"), (end - F.col("a")).alias("n")).where("n > 0")

    def taken(self) -> DataFrame:
        """A row for each document: doc_id, size, source_size, target, taken."""
        got = self.pieces().groupBy("source_ix", "start").agg(F.sum("n").alias("taken"))
        return self.placed().join(got, ["source_ix", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")

    def texts(self) -> DataFrame:
        """The mix itself: shard, slot, epoch, block, source, doc_id, at, n, and the stretch as it stands in the text."""
        cut, key = F.struct("shard", "slot", "epoch", "block", "at", "n"), ("doc_id", "mark", "source")
        lists = self.pieces(*key).groupBy(*key, "source_ix", "start").agg(F.collect_list(cut).alias("cuts")).drop("source_ix", "start")
        lists = keep(lists).hint("shuffle_hash")
        docs = self.docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), F.col("source").cast("string").alias("source"), "text")
        if self.most > 1:  # one text for all copies of a row
            again = bounded(keep(self.groups.where("copies > 1").select(*key)))
            once, more = (docs.join(again, same(docs, again, *key), how) for how in ("left_anti", "left_semi"))
            docs = once.unionByName(more.dropDuplicates(list(key)))
        met = docs.join(lists, same(docs, lists, *key)).select(docs["doc_id"], docs["source"], "text", "cuts")
        words = F.regexp_extract_all("text", F.lit(f"{WORD}[{SPACE}]*"), F.lit(0))  # each with the white space behind it
        stretch = lambda w, c: F.rtrim(F.array_join(F.slice(w, (c["at"] + 1).cast("int"), c["n"].cast("int")), ""), F.lit(SPACES))
        cuts = F.transform(F.array(words), lambda w: F.transform("cuts", lambda c: F.struct(*(c[x].alias(x) for x in ("shard", "slot", "epoch", "block", "at", "n")), stretch(w, c).alias("text"))))  # as ``w`` a text's words are found once, not once a cut
        return met.select("doc_id", "source", F.inline(cuts[0])).select("shard", "slot", "epoch", "block", "source", "doc_id", "at", "n", "text")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus of ``docs(doc_id, text, source)``, a row for each stretch of a document in a slot."""
    return Mix(spread(docs), **options).texts()


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """How many words the mix takes of each document: doc_id, size, source_size, target, taken, source."""
    return Mix(spread(docs), **options).taken()
