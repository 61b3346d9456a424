"""Exact top-k cosine search: one query, a batch, or a similarity join.

One query is a filter, a scored projection and a bounded top-k (``TakeOrderedAndProject``). Many queries are a join of
*blocks*: vectors are packed a few thousand to a row and written once, blocks with equal filter keys meet, a matrix product
finds the rows of a block that can still be among a query's best, and those are scored exactly. A task holds a share of the
queries, with their best rows so far, while a share of the corpus streams by: no pair of blocks is shuffled, only k rows a query
and share. Blocks are dealt over all tasks, so one large filter group is no hot spot. Ranking is (cosine as float, descending; id)."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.vectors import cosine, score
from pathloom.operators import blocks
from pathloom.schema import blank
from pathloom.scratch import keep

#: ``SMALL``: pairs of blocks up to which a group's blocks are joined like any rows.
MAX_K, SMALL = 100, 16


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}")
    return k


def check_vector(vector: Sequence[float], dimension: int | None = None) -> list[float]:
    v = np.asarray(vector, dtype=np.float32)
    if dimension is not None and len(v) != dimension:
        raise ValueError(f"query has {len(v)} dimensions, the corpus {dimension}")
    if not len(v) or not np.isfinite(v).all() or not v.any():
        raise ValueError("query vectors must be finite and not zero")
    return v.tolist()


def matching(df: DataFrame, platform: str | None = None, app: str | None = None, success: bool | None = None) -> DataFrame:
    """Rows with the given values; null and blank mean any. Equalities reach the Parquet scan."""
    for name, value in (("platform", platform), ("app", app)):
        if value is not None and value.strip():
            df = df.where(F.col(name) == value)
    return df if success is None else df.where(F.col("success") == success)


def search(corpus: DataFrame, embedding: Sequence[float], k: int = 5, platform: str | None = None, app: str | None = None, success: bool | None = None) -> DataFrame:
    """The ``k`` nearest rows, without embedding, with cos, score and rank."""
    query = F.array(*[F.lit(x).cast("float") for x in check_vector(embedding)])
    length = F.lit(float(np.sqrt(np.cumsum(np.asarray(embedding, np.float32).astype(float) ** 2)[-1])))
    found = matching(corpus, platform, app, success).withColumn("cos", cosine(F.col("embedding"), query, None, length))
    top = found.drop("embedding").orderBy(F.desc("cos"), "id").limit(check_k(k))
    return top.withColumn("score", score(F.col("cos"))).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cos"), "id")))


def knn_join(
    queries: DataFrame, corpus: DataFrame, keys: Sequence[str] = (), k: int = 10, block: int = blocks.BLOCK, masks: Sequence[str] = (), least: float | None = None, cells: int = 0
) -> DataFrame:
    """(qid, id, cos, rank): for each row of ``queries(qid, embedding, *keys[, k])`` its nearest rows of ``corpus(id, embedding, *keys)``.

    A column ``k`` in ``queries`` overrides the argument. Null keys match nothing. Rows without an embedding are left out.
    ``masks`` are filter columns of both sides, any value matching a query's null. ``least``: results have this cosine, as
    float, at least. ``cells``: instead of keys, rows have a ``cell`` under this number and queries an array ``cells``."""
    keys, masks, spark = list(keys), list(masks), queries.sparkSession
    if "k" not in queries.columns:
        queries = queries.withColumn("k", F.lit(check_k(k)))
    by = ["cell"] if cells else keys
    ask = _known(queries, keys).select(F.col("qid").alias("id"), "embedding", F.col("k").cast("int").alias("k"), *keys, *masks, *(["cells"] if cells else []))
    rows = _known(corpus, by).select("id", "embedding", *by, *masks)
    kinds = f"qid {dict(queries.dtypes)['qid']}, id {dict(corpus.dtypes)['id']}, cos float, k int"
    asked = ask.groupBy(*keys).agg(F.count("*").alias("nq"), F.max(F.size("embedding")).alias("dq"), F.max("k").alias("most"))
    there = rows.groupBy(*by).agg(F.count("*").alias("nc"), F.max(F.size("embedding")).alias("dc"))
    groups = keep((asked.join(there, keys) if keys else there.crossJoin(F.broadcast(asked))).coalesce(1))  # without keys: one row of queries
    total = groups.agg(F.max(F.greatest("dq", "dc")).alias("d"), F.max("most").alias("most"), F.sum("nc").alias("nc"), (F.sum if keys else F.max)("nq").alias("nq")).first()
    if not total.nq or not total.nc:
        return spark.createDataFrame([], kinds).withColumn("rank", F.lit(0)).drop("k")
    size = blocks.block_rows(total.d, block)
    parts = lambda n: F.when(F.col(n) <= size, 1).otherwise(F.ceil(F.col(n) / max(1, size * 7 // 8))).cast("long")
    groups = groups.withColumn("pq", parts("nq")).withColumn("pc", parts("nc"))
    number = F.col("cell").cast("long") if cells else F.monotonically_increasing_id() + 1
    small = F.col("pq") * F.col("pc") <= SMALL if keys else F.lit(False)
    groups = groups.withColumn("gid", F.when(small, -number).otherwise(number))  # groups of few blocks have negative numbers
    left, right = (groups.select(*keys, "gid", F.col("pq").alias("parts")) if keys else groups.limit(1).select(F.lit(0).cast("long").alias("gid"), F.col("pq").alias("parts"))), groups.select(*by, "gid", F.col("pc").alias("parts"))
    files = [blocks.files(spark, n, total.d, size) for n in (total.nq, total.nc)]
    # equal vectors come together, as only the first of them by id can be among the nearest
    q = blocks.pack(_dealt(ask, left, keys, files[0], F.xxhash64("id")), size, None, ["k", *masks], cells)
    c = blocks.pack(_dealt(rows, right, by, files[1], F.xxhash64("embedding", *masks)), size, total.most, masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best(batches, total.d, masks, least, bool(cells))

    met = []
    if keys and groups.where("gid < 0").limit(1).count():
        met.append(blocks.meet_small(c.where("gid < 0"), q.where("gid < 0")))
    big = groups.where("gid >= 0").agg(F.sum("pc").alias("c"), (F.sum if keys else F.max)("pq").alias("q"), (F.sum if keys else F.max)("nq").alias("n")).first()
    if big.n:
        same = F.col("a_gid") == F.col("b_gid") if keys else None
        met.append(blocks.meet(c.where("gid >= 0"), q.where("gid >= 0"), same, 4 * total.d * big.n, (big.c, big.q)))
    found = functools.reduce(DataFrame.unionByName, [pairs.mapInArrow(run, kinds) for pairs in met])
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "id"))
    return found.withColumn("rank", rank).where("rank <= k").drop("k")


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    return functools.reduce(lambda d, c: d.where(F.col(c).isNotNull()), ["embedding", *keys], df)


def _dealt(df: DataFrame, groups: DataFrame, keys: list[str], files: int, mark: Column) -> DataFrame:
    """``df`` with gid and part of ``groups(*keys, gid, parts)``, rows of a part together, in order of mark and id."""
    df = df.join(groups, keys) if keys else df.crossJoin(F.broadcast(groups))  # without keys: one row
    df = df.withColumn("mark", mark).withColumn("part", F.pmod("mark", "parts"))
    return df.repartition(files, "gid", "part").sortWithinPartitions("gid", "part", "mark", "id")


def _best(batches: Iterator[pa.RecordBatch], dimension: int, masks: list[str], least: float | None, cells: bool) -> Iterator[pa.RecordBatch]:
    """The best rows of each block of queries (b) among the blocks (a) that come with it."""
    best: dict[tuple, _Best] = {}
    at, c = None, None
    for batch in batches:
        names = zip(*[batch.column(f"{s}_{n}").to_pylist() for s in "ab" for n in ("gid", "part", "nth")], strict=True)
        for i, name in enumerate(names):
            if name[:3] != at:
                at, c = name[:3], blocks.Block(batch, "a", i, dimension)
                units, theirs = np.ascontiguousarray(c.units().T), [np.array(c.list(m).to_pylist(), dtype=object) for m in masks]
            q = blocks.Block(batch, "b", i, dimension)
            if name[3:] not in best:
                best[name[3:]] = _Best(q, masks, least)
            best[name[3:]].see(q, c, units, theirs, q.cells(at[0]) if cells else np.arange(len(q.len)))
    for one in best.values():
        yield from one.results()


class _Best:
    """The best rows so far of a block of queries, by tiles. ``bar``: the cosine that a further row of a query must reach."""

    def __init__(self, q: blocks.Block, masks: list[str], least: float | None) -> None:
        n = len(q.len)
        self.ids, self.k = q.list("id").take(pa.array(np.arange(n))), np.array(q.list("k").to_pylist())
        self.bar = np.full(n, -2.0 if least is None else float(np.float32(least)))
        kinds: dict[tuple, int] = {}
        asked = zip(*[q.list(m).to_pylist() for m in masks], strict=True) if masks else ()
        self.kind, self.kinds = np.array([kinds.setdefault(x, len(kinds)) for x in asked]), list(kinds)
        self.tiles: dict[int, tuple] = {}
        self.slack, self.type = blocks.margin(q.x.shape[1]), None

    def see(self, q: blocks.Block, c: blocks.Block, units: np.ndarray, theirs: list[np.ndarray], rows: np.ndarray) -> None:
        self.type = c.list("id").type
        fit = [np.logical_and.reduce([np.ones(units.shape[1], bool), *[t == v for t, v in zip(theirs, kind, strict=True) if v is not None]]) for kind in self.kinds]
        for tile in range(0, len(self.k), blocks.TILE):
            r = rows[np.searchsorted(rows, tile) : np.searchsorted(rows, tile + blocks.TILE)]
            if not len(r):
                continue
            near = (q.x[r[0] : r[-1] + 1] if len(r) == r[-1] + 1 - r[0] else q.x[r]) @ units
            for kind in set(self.kind[r].tolist()) if self.kinds else ():
                if not fit[kind].all():
                    near[np.ix_(np.flatnonzero(self.kind[r] == kind), np.flatnonzero(~fit[kind]))] = -np.inf
            at, col = self._candidates(near, r, q.len[r])
            if len(at):
                cos = blocks.exact(q, c, r[at], col)
                good = np.flatnonzero(cos >= self.bar[r[at]])
                if len(good):
                    self._take(tile, r[at[good]], cos[good], np.array([*c.list("id").take(pa.array(col[good])).to_pylist(), None], dtype=object)[:-1])

    def _candidates(self, near: np.ndarray, r: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slack, k, m = self.slack, self.k[r], near.shape[1]
        low = (self.bar[r] - slack) * length
        hit = near >= low.astype(np.float32)[:, None]
        most = int(k.max())
        if most < m and np.count_nonzero(hit) > 4 * most * len(r):
            top = np.sort(np.partition(near, m - most, axis=1)[:, m - most :], axis=1)
            hit = near >= np.maximum(low, top[np.arange(len(r)), most - k] - 2 * slack * length).astype(np.float32)[:, None]
        return np.divmod(np.flatnonzero(hit), m)

    def _take(self, tile: int, row: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> None:
        if tile in self.tiles:
            had = self.tiles[tile]
            touched = np.zeros(blocks.TILE, bool)
            touched[row - tile] = True
            again = touched[had[0] - tile]
            row, cos, ids = (np.concatenate([h[again], new]) for h, new in zip(had, (row, cos, ids), strict=True))
            rest = tuple(h[~again] for h in had)
        else:
            rest = tuple(x[:0] for x in (row, cos, ids))
        order = np.lexsort((-cos, row))
        tied = (row[order][1:] == row[order][:-1]) & (cos[order][1:] == cos[order][:-1])
        if tied.any():
            order = np.lexsort((pd.factorize(ids, sort=True)[0], -cos, row))
        row, cos, ids = row[order], cos[order], ids[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        last = place == self.k[row] - 1
        self.bar[row[last]] = cos[last]
        stay = place < self.k[row]
        self.tiles[tile] = tuple(np.concatenate([old, new[stay]]) for old, new in zip(rest, (row, cos, ids), strict=True))

    def results(self) -> Iterator[pa.RecordBatch]:
        for row, cos, ids in self.tiles.values():
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), pa.array(ids.tolist(), self.type), pa.array(cos), pa.array(self.k[row].astype(np.int32))], ["qid", "id", "cos", "k"])


def search_batch(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``queries(qid, embedding, k, platform, app, success)``: null or blank filters match any; (qid, id, cos, rank).

    Queries of all combinations of filters go through one join: the filter columns are packed into the blocks and mask
    the block's product."""
    keys = ("platform", "app", "success")
    wild = [F.when(~blank(F.col(c)), F.col(c)).alias(c) for c in keys[:2]]
    asked = queries.select("qid", "embedding", "k", *wild, "success")
    return knn_join(asked, corpus.select("id", "embedding", *keys), (), masks=keys)


def without(ranked: DataFrame, excluded: Column, k: int) -> DataFrame:
    """Ranked rows (qid, id, cos, rank) less those that ``excluded`` marks, ranked again, ``k`` kept."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return ranked.where(~F.coalesce(excluded, F.lit(False))).withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(queries: DataFrame, corpus: DataFrame, k: int = 5, keys: Sequence[str] = ("platform", "app")) -> DataFrame:
    """For rows of the corpus as queries: min(100, k + 1) are fetched, self is dropped, ``k`` stay."""
    found = knn_join(queries.withColumnRenamed("id", "qid"), corpus, keys, min(MAX_K, check_k(k) + 1))
    return without(found, F.col("id") == F.col("qid"), k)


def search_by_id(corpus: DataFrame, trajectory_id: str, k: int = 5, success: bool | None = None) -> DataFrame:
    """Neighbours of one stored row among those of its platform and app. An unknown id is a KeyError."""
    row = corpus.where(F.col("id") == trajectory_id).select("embedding", "platform", "app").first()
    if row is None:
        raise KeyError(trajectory_id)
    found = search(corpus, row.embedding, min(MAX_K, check_k(k) + 1), row.platform, row.app, success)
    rank = F.row_number().over(Window.orderBy("rank"))
    return found.where(F.col("id") != trajectory_id).withColumn("rank", rank).where(F.col("rank") <= k)
