"""Exact BM25 top-k: an inverted index for each shard, built once, block-max WAND pruning, an exact merge with global statistics.

``build`` cuts the documents into shards and writes each shard's index as one row of a table in the shared folder, so no
text is read again. Within a shard, documents with the same rarest words stand together, so that the maxima of blocks of
``BLOCK`` documents differ. Document frequencies, the number of documents and their mean length come from all shards, so
that a score does not depend on the shard. Queries go round in blocks of ``TERMS`` terms (the bound on what is broadcast,
one block at a time). A task keeps the k-th best score of each query so far, the WAND threshold, which carries from shard
to shard; so there are ``WAVES`` tasks for each core at most. WAND moves cursors document by document; here its two tests
are made for all documents of a shard and up to ``QUERIES`` queries at once:

* pivot: of the terms in over ``DENSE`` of the documents those are set aside whose maxima together stay below the threshold
  (those with the most postings for their maximum first): a document that has only such terms can be no pivot. The rest is
  scored, terms in over ``ROWS`` of the documents by one matrix product for all the queries, others posting by posting;
* block maxima: a document is a candidate only if its score so far and the maxima, in its block, of the terms set aside
  reach the threshold. Only candidates are scored for these terms;
* candidates within float32 error of the best k are scored again in float64, terms in one fixed order, so equal documents
  have equal scores and ties go to the smaller doc_id.

Each task sends k rows a query; they merge by rank. The work is queries times shards by nature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import forget, keep, lookup, spread
from pathloom.llm.rolling import mix, word_hashes

#: Documents and characters of a shard (a longer text is a shard of its own), documents of a block, terms of a block of queries.
K1, B, SHARD, CHARS, BLOCK, TERMS = 1.2, 0.75, 4096, 16_000_000, 8, 4_000_000
#: Terms in a larger share of a shard's documents are kept as rows of a matrix; those in a share over ``DENSE`` may be set aside.
ROWS, DENSE = 0.05, 0.2
#: Tasks of a search for each core, at most: thresholds carry from shard to shard within a task.
WAVES = 4
#: How far float32 sums may be off; queries scored at once at most, and postings of these, about; scores completed at once.
SLACK, QUERIES, POSTINGS, PAIRS = 0.9995, 256, 500_000, 20_000
CHUNK = 2_000_000
INDEX = "sizes binary, terms binary, first binary, doc binary, tf binary"


def _terms(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, term, tf of each distinct (doc, term), by doc and term; words of each text."""
    docs, terms, counts, sizes = [], [], [], np.zeros(len(texts), dtype=np.int64)
    a = total = 0
    cuts = []
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if total and total + n > CHUNK:
            cuts.append((a, i))
            a, total = i, 0
        total += n
    for lo, hi in [*cuts, (a, len(texts))]:
        h, d = word_hashes(texts[lo:hi])
        sizes[lo:hi] = np.bincount(d, minlength=hi - lo)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(d, prepend=-1) != 0)) if len(h) else np.zeros(0, int)
        docs.append(d[new] + lo)
        terms.append(h[new])
        counts.append(np.diff(np.append(new, len(h))))
    return np.concatenate(docs), np.concatenate(terms), np.concatenate(counts), sizes


def _order(doc: np.ndarray, owner: np.ndarray, df: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    """Documents by the smallest mixed hash of their terms that another document of the shard has too."""
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    shared = df[owner] > 1
    if shared.any():
        d, h = doc[shared], mix(terms)[owner[shared]]  # by doc
        new = np.flatnonzero(np.diff(d, prepend=-1))
        least[d[new]] = np.minimum.reduceat(h, new)
    return np.argsort(least, kind="stable")


def index_of(ids: list, texts: list) -> tuple[list, bytes, bytes, bytes, bytes, bytes]:
    """A shard's index: ids in its order, words of each document, terms in order, their first postings, documents, counts."""
    doc, term, tf, sizes = _terms(texts)
    terms, owner, df = np.unique(term, return_inverse=True, return_counts=True)
    order = _order(doc, owner, df, terms, len(texts))
    place = np.empty(len(texts), dtype=np.int64)
    place[order] = np.arange(len(texts))
    doc = place[doc]
    by = np.lexsort((doc, owner))
    first = np.append(0, np.cumsum(df))
    parts = (sizes[order], np.uint32), (terms, np.uint64), (first, np.uint32), (doc[by], np.uint16), (tf[by], np.uint32)
    return [ids[i] for i in order.tolist()], *(x.astype(kind).tobytes() for x, kind in parts)


def build(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The index of ``docs(doc_id, text)``: one row for each shard of up to ``shard`` documents (65,536 at most)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total, of = [], [], 0, None

        def row() -> pa.RecordBatch:
            mine, *rest = index_of(ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([mine], pa.list_(of)), *(pa.array([x], pa.binary()) for x in rest)], ["ids", *(c.split()[0] for c in INDEX.split(", "))])

        for batch in batches:
            of = batch.schema.field("doc_id").type
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size = len(text) if isinstance(text, str) else 0
                if ids and (len(ids) == shard or total + size > CHARS):
                    yield row()
                    ids, texts, total = [], [], 0
                ids.append(i)
                texts.append(text)
                total += size
        if ids:
            yield row()

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"ids array<{kind}>, {INDEX}")


def statistics(index: DataFrame) -> DataFrame:
    """(kind, term, n): 0: documents with the term; 1: documents; 2: words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, terms, first in zip(*(batch.column(c).to_pylist() for c in ("sizes", "terms", "first")), strict=True):
                sizes = np.frombuffer(sizes, np.uint32)
                df = np.diff(np.frombuffer(first, np.uint32).astype(np.int64))
                kind = np.append(np.zeros(len(df), np.int32), np.array([1, 2], np.int32))
                term = np.append(np.frombuffer(terms, np.int64), [0, 0])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(term), pa.array(np.append(df, [len(sizes), int(sizes.sum(dtype=np.int64))]))], ["kind", "term", "n"])

    return index.select("sizes", "terms", "first").mapInArrow(run, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def _query_terms(queries: DataFrame) -> DataFrame:
    kind = queries.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, _, _ = _terms(batch.column("text").to_pylist())
            for a in range(0, len(doc), CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[a : a + CHUNK])), pa.array(term[a : a + CHUNK].view(np.int64))], ["query", "term"])

    return queries.select("doc_id", "text").mapInArrow(run, f"query {kind}, term long").distinct()


class Shard:
    """An index row, opened: scores need only the mean number of words. ``touched`` counts the postings that were scored."""

    def __init__(self, ids: list, sizes: bytes, terms: bytes, first: bytes, doc: bytes, tf: bytes, mean_words: float):
        size, tf = np.frombuffer(sizes, np.uint32), np.frombuffer(tf, np.uint32)
        self.ids, self.n, self.terms = ids, len(ids), np.frombuffer(terms, np.uint64)
        self.first, self.doc = np.frombuffer(first, np.uint32).astype(np.int64), np.frombuffer(doc, np.uint16)
        self.weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / max(mean_words, 1e-9)))
        df = np.diff(self.first)
        rows = np.concatenate((np.flatnonzero(df > DENSE * self.n), np.flatnonzero((df > ROWS * self.n) & (df <= DENSE * self.n))))
        self.often = int((df > DENSE * self.n).sum())  #: the first rows may be set aside
        self.row = np.full(len(self.terms), -1)
        self.row[rows] = np.arange(len(rows))
        self.df = df
        blocks = -(-self.n // BLOCK)
        self.matrix = np.zeros((len(rows), blocks * BLOCK), dtype=np.float32)
        for j, t in enumerate(rows.tolist()):
            some = slice(self.first[t], self.first[t + 1])
            self.matrix[j, self.doc[some]] = self.weight[some]
        self.by_doc = np.ascontiguousarray(self.matrix[: self.often].T)
        self.block_max = self.matrix[: self.often].reshape(self.often, blocks, BLOCK).max(axis=2)
        self.most, self.most_df = self.block_max.max(axis=1, initial=0), df[rows[: self.often]]
        by = np.argsort(self.doc, kind="stable")
        self.doc_first = np.append(0, np.cumsum(np.bincount(self.doc, minlength=self.n)))
        self.doc_term, self.doc_weight = np.repeat(np.arange(len(self.terms), dtype=np.int32), df)[by], self.weight[by]
        self.at = np.full(len(self.terms), -1, dtype=np.int32)  #: for ``exact``
        self.touched = 0

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The number of each of ``terms`` in the shard, -1 for none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        at[self.terms[at] != terms] = -1
        return at

    def batches(self, q: np.ndarray, t: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Runs of the queries 0 to ``n``, of ``QUERIES`` and about ``POSTINGS`` at most; ``q`` are the queries of the terms ``t``."""
        each = np.bincount(q, np.where(self.row[t] < 0, self.df[t], 0), minlength=n)
        part = np.cumsum(each) // POSTINGS * n + np.arange(n) // QUERIES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        yield from zip(cuts[:-1], cuts[1:], strict=True)

    def price(self, t: np.ndarray, idf: np.ndarray) -> None:
        """Sets the weights of the terms with numbers ``t``, the same for all queries to come; the other terms weigh nothing."""
        self.idf = np.zeros(len(self.terms))
        self.idf[t] = idf
        self.gain = self.weight * np.repeat(self.idf, self.df)

    def candidates(self, t: np.ndarray, idf: np.ndarray, k: int, floor: float) -> np.ndarray:
        """``candidates_of`` for one query of the terms ``t`` with weights ``idf``."""
        self.price(t, idf)
        return self.candidates_of(np.zeros(len(t), dtype=np.int64), t, k, np.array([floor]))[1]

    def candidates_of(self, q: np.ndarray, t: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and document, by query, among which each query's best ``k`` are that reach its ``floor``; ``q`` are the queries of the terms ``t``."""
        m, width, a = len(floor), self.matrix.shape[1], self.often
        row = self.row[t]
        few, many = row < 0, row >= 0
        n = self.df[t[few]]
        posting = np.arange(n.sum())
        posting += np.repeat(self.first[t[few]] - np.cumsum(n) + n, n)
        at = np.repeat(q[few] * width, n)
        at += self.doc[posting]
        score = np.bincount(at, self.gain[posting], minlength=m * width)
        score = score.reshape(m, width).astype(np.float32)
        weight = np.zeros((m, len(self.matrix)), dtype=np.float32)
        weight[q[many], row[many]] = self.idf[t[many]]
        if weight[:, a:].any():
            score += weight[:, a:] @ self.matrix[a:]
        now = weight[:, :a]
        order = np.argsort(now.max(axis=0, initial=0) * self.most / self.most_df)
        rest = np.zeros_like(now)
        rest[:, order] = np.where(np.cumsum((now * self.most)[:, order], axis=1, dtype=np.float64) < SLACK * floor[:, None], now[:, order], 0)
        now = now - rest
        used, aside = np.flatnonzero(now.any(axis=0)), np.flatnonzero(rest.any(axis=0))
        if len(used):
            score += now[:, used] @ self.matrix[used]
        self.touched += len(posting) + int(self.df[t[row >= a]].sum()) + int(((now > 0) @ self.most_df).sum())
        bound = score
        if len(aside):
            bound = (score.reshape(m, -1, BLOCK) + (rest[:, aside] @ self.block_max[aside])[:, :, None]).reshape(m, width)
        query, doc = np.nonzero((bound >= (SLACK * floor).astype(np.float32)[:, None]) & (bound > 0))
        score = score[query, doc]
        if len(aside):
            terms = (rest > 0).sum(axis=1)
            open_ = np.flatnonzero(terms[query])
            self.touched += int(terms[query].sum())
            for at in range(0, len(open_), PAIRS):
                some = open_[at : at + PAIRS]
                score[some] += np.einsum("ij,ij->i", rest[query[some]], self.by_doc[doc[some]])
        ends = np.searchsorted(query, np.arange(m + 1))
        floor = floor.copy()
        for i in np.flatnonzero(np.diff(ends) > k).tolist():
            mine = score[ends[i] : ends[i + 1]]
            floor[i] = max(floor[i], float(np.partition(mine, len(mine) - k)[len(mine) - k]))
        kept = (score >= SLACK * floor[query]) & (score > 0)
        return query[kept], doc[kept]

    def exact(self, t: np.ndarray, idf: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of ``docs`` in float64, terms in order of their hash."""
        runs = [slice(a, z) for a, z in zip(self.doc_first[docs].tolist(), self.doc_first[docs + 1].tolist(), strict=True)]
        if not runs:
            return np.zeros(0)
        self.at[t] = np.arange(len(t))
        at = self.at[np.concatenate([self.doc_term[x] for x in runs])]
        self.at[t] = -1
        ok = np.flatnonzero(at >= 0)
        of = np.repeat(np.arange(len(docs)), self.doc_first[docs + 1] - self.doc_first[docs])[ok]
        return np.bincount(of, idf[at[ok]] * np.concatenate([self.doc_weight[x] for x in runs])[ok], minlength=len(docs)).astype(np.float64)


def _search(index: DataFrame, query: np.ndarray, term: np.ndarray, idf: np.ndarray, n: int, k: int, mean_words: float) -> DataFrame:
    """(q, doc_id, score), kept: the best k of each task for each query number."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    order = np.lexsort((term, query))
    first = np.searchsorted(query[order], np.arange(n + 1))
    every, one, which = np.unique(term[order], return_index=True, return_inverse=True)
    shared = index.sparkSession.sparkContext.broadcast((first, which.astype(np.int32), every, idf[order][one]))  # a term has one weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, which, every, price = shared.value
        best: list[list[tuple]] = [[] for _ in range(n)]
        floor, of = np.zeros(n), None

        def search(shard: Shard) -> None:
            place = shard.places(every)
            shard.price(place[place >= 0], price[place >= 0])
            for lo in range(0, n, QUERIES):
                hi = min(n, lo + QUERIES)
                q, t = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1])), place[which[first[lo] : first[hi]]]
                q, t = q[t >= 0], t[t >= 0]
                own = np.searchsorted(q, np.arange(hi - lo + 1))
                for a, z in shard.batches(q, t, hi - lo):
                    some = slice(own[a], own[z])
                    asked, docs = shard.candidates_of(q[some] - a, t[some], k, floor[lo + a : lo + z])
                    ends = np.searchsorted(asked, np.arange(z - a + 1)).tolist()
                    for i in np.unique(asked).tolist():
                        terms, mine = t[own[a + i] : own[a + i + 1]], docs[ends[i] : ends[i + 1]]
                        found = shard.exact(terms, shard.idf[terms], mine)
                        i += lo + a
                        both = [*best[i], *((-round(s, 9), shard.ids[j]) for s, j in zip(found.tolist(), mine.tolist(), strict=True) if s > 0)]
                        best[i] = sorted(both, key=lambda x: (x[0], x[1] is None, x[1] or 0))[:k]
                        if len(best[i]) == k:
                            floor[i] = -best[i][-1][0]

        for batch in batches:
            of = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                search(Shard(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "terms", "first", "doc", "tf")), mean_words))
        got = [(q, doc, -s) for q, rows in enumerate(best) for s, doc in rows]
        for a in range(0, len(got), 100_000):
            q, doc, s = zip(*got[a : a + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, of), pa.array(s, pa.float64())], ["q", "doc_id", "score"])

    cores = index.sparkSession.sparkContext.defaultParallelism
    found = keep(spread(index).coalesce(WAVES * cores).mapInArrow(run, f"q int, doc_id {kind}, score double"))
    shared.destroy()
    return found


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, terms: int = TERMS) -> DataFrame:
    """query_id, rank, doc_id, score: the ``k`` best documents for each row of ``queries(doc_id, text)``.

    A query is the set of its text's words; it finds itself if it is in ``docs``. Documents without a common word are not
    found, so a null or empty text finds and is found by none. Equal scores rank by doc_id, null last; rows that repeat
    a document are found each. Queries with equal doc_id are one query of all their words; those of null doc_id are left
    out. Columns but doc_id and text are not read. ``shard`` and ``terms`` bound memory and do not change the result.
    """
    index = keep(build(docs, shard))
    stats = keep(statistics(index))
    known = {r.kind: r.n for r in stats.where("kind > 0").collect()}
    total, words = known.get(1, 0), known.get(2, 0)
    asked = keep(_query_terms(queries.where("doc_id is not null")))
    used = keep(asked.groupBy("term").agg(F.count("*").alias("uses")).join(stats.where("kind = 0").select("term", F.col("n").alias("df")), "term"))
    asked = lookup(asked, used, ["term"], "uses").select("query", "term", "df")
    numbers = keep(_numbered(asked, terms))
    asked = keep(asked.join(numbers, "query").select("q", "block", "term", "df"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"q long, doc_id {kind}, score double")
    for block in range((numbers.agg(F.max("block")).first()[0] or 0) + 1):
        got = asked.where(F.col("block") == block).select("q", "term", "df").toArrow()  # ``terms`` and one query at most
        query, term, df = (got[c].to_numpy() for c in ("q", "term", "df"))
        if len(query):
            a, n = int(query.min()), int(query.max() - query.min()) + 1
            found = _search(index, (query - a).astype(np.int32), np.ascontiguousarray(term).view(np.uint64), np.log1p((total - df + 0.5) / (df + 0.5)), n, k, words / max(1, total))
            out = out.unionByName(found.withColumn("q", F.col("q") + F.lit(a).cast("long")))
    for table in (index, stats, used, asked):
        forget(table)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(numbers, "q").select(F.col("query").alias("query_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


def _numbered(asked: DataFrame, terms: int) -> DataFrame:
    """(query, q, block) for ``asked(query, term)``: consecutive numbers, and blocks of about ``terms`` rows of ``asked`` in that order.

    Places and rows come from running sums within hash buckets after the buckets' totals."""
    rows = keep(asked.groupBy("query").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("query"), F.lit(1024))))
    base = rows.groupBy("bucket").agg(F.count("*").alias("queries"), F.sum("n").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows at most
    base = base.select("bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("queries", "rows")))
    here = Window.partitionBy("bucket").orderBy("query")
    q, row = F.row_number().over(here) - 1, F.sum("n").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = rows.withColumns({"at": q, "row": row}).join(F.broadcast(base), "bucket")
    return placed.select("query", (F.col("queries") + F.col("at")).alias("q"), F.floor((F.col("rows") + F.col("row")) / terms).cast("int").alias("block"))
