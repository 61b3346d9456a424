"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network with calibrated probabilities.

Random indexing (Kanerva; Sahlgren): every word has a fixed sparse random vector, its *index* (``NONZERO`` signed ones among
``DIM``, read off its hash, so there is no table of them); a word's *meaning* is the sum of the indices of its neighbours
over all documents. Words are runs of letters, of digits or of other signs, as they are written, so "word" and "WORD" and
"###" are words of their own. Every word has its own vector: words that make up one in ``RARE`` of all words (at least
``LEAST`` times) their meaning, rarer ones, whose neighbours say little, their index; all have length one.

A document is the mean vector of its different words beside the two sizes of that pool: the share of its words that are
different, and the log of their number; a tanh layer and a logistic output, fitted in numpy, judge it; one temperature, fitted on rows kept out of the fit, calibrates the probability.

Word counts and meanings cover every document: partitions add up their own, shuffles add the partitions' sums, blocks of
words first in ``SALT`` parts. At most ``RARE`` words have a meaning, so sums take ``RARE`` x ``DIM`` numbers in a worker, and
a byte for each of them on the driver and in the broadcast. The network fits on about ``PER_LABEL`` documents of each label
(those of lowest id hash).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import crc_mod, keep, labelled, sampled, spread
from pathloom.llm.rolling import Rolling

DIM, NONZERO, HIDDEN, PER_LABEL, CHUNK = 256, 4, 24, 4000, 1_500_000
RARE, LEAST, BLOCK, SALT = 200_000, 5, 1024, 64
#: White space 0, other ASCII signs 1, digits 2, letters (and any byte beyond ASCII) 3.
KIND = np.ones(256, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = 2
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 3


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For runs of one kind of byte, in order: hash, text number."""
    data = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    b = np.frombuffer(b"\n".join([*data, b""]), dtype=np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(KIND[b])) + 1
    a, z = np.append(0, cut), np.append(cut, len(b))
    some = KIND[b[a]] > 0
    a, z = a[some], z[some]
    return Rolling(b).at(a, z), np.searchsorted(np.cumsum([len(d) + 1 for d in data]), a, side="right")


def _batches(texts) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``CHUNK`` characters (a longer text alone)."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if size and size + n > CHUNK:
            yield a, i
            a, size = i, 0
        size += n + 1
    if len(texts) > a:
        yield a, len(texts)


def index_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (words x ``NONZERO``) and signs of the index vectors."""
    at = np.stack([(h >> np.uint64(8 * j)) & np.uint64(DIM - 1) for j in range(NONZERO)], axis=1).astype(np.int64)
    sign = np.stack([(h >> np.uint64(40 + j)) & np.uint64(1) for j in range(NONZERO)], axis=1).astype(np.int64)
    return at, 2 * sign - 1


def common_words(docs: DataFrame) -> np.ndarray:
    """The hashes, sorted, of the words that have a meaning vector."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in parts:
            texts = part["text"].tolist()
            for a, z in _batches(texts):
                more, n = np.unique(words(texts[a:z])[0], return_counts=True)
                seen, at = np.unique(np.append(seen, more), return_inverse=True)
                counts = np.bincount(at, np.append(counts, n), minlength=len(seen)).astype(np.int64)
                if len(seen) > 1_000_000:
                    yield pd.DataFrame({"w": seen.view(np.int64), "n": counts})
                    seen, counts = seen[:0], counts[:0]
        yield pd.DataFrame({"w": seen.view(np.int64), "n": counts})

    found = keep(spread(docs.select("text")).mapInPandas(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    return np.sort(found.where(F.col("n") >= max(LEAST, -(-total // RARE))).select("w").toArrow()["w"].to_numpy().view(np.uint64))


def _add_neighbours(near: np.ndarray, known: np.ndarray, texts: list) -> None:
    """Add to the rows of ``near`` the indices of the words beside each known word."""
    h, doc = words(texts)
    if not len(h) or not len(known):
        return
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    mine, beside = known[at] == h, doc[1:] == doc[:-1]
    for who, other in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):
        ok = beside & mine[who]
        place, sign = index_of(h[other][ok])
        cell, to = np.unique((at[who][ok][:, None] * DIM + place).reshape(-1), return_inverse=True)
        near.reshape(-1)[cell] += np.bincount(to, sign.reshape(-1), minlength=len(cell)).astype(np.int32)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Blocks of ``rows(block, part, sums)`` added up by ``keys``, one after the other."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for part in parts:
            for block, salt, data in part[["block", "part", "sums"]].itertuples(index=False):
                now = (block, salt) if len(keys) > 1 else (block, 0)
                if now != at:
                    if at is not None:
                        yield pd.DataFrame([(*at, zlib.compress(total.tobytes(), 1))], columns=["block", "part", "sums"])
                    at, total = now, np.zeros(BLOCK * DIM, np.int64)
                total = total + np.frombuffer(zlib.decompress(data), np.int64)
        if at is not None:
            yield pd.DataFrame([(*at, zlib.compress(total.tobytes(), 1))], columns=["block", "part", "sums"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "block int, part int, sums binary")


def word_vectors(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """The meanings of the known words, scaled to length 127, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        known, salt = shared.value, TaskContext.get().partitionId() % SALT
        near = np.zeros((-(-len(known) // BLOCK) * BLOCK, DIM), dtype=np.int32)
        for part in parts:
            texts = part["text"].tolist()
            for a, z in _batches(texts):
                _add_neighbours(near, known, texts[a:z])
        for k in range(len(near) // BLOCK):
            sums = near[k * BLOCK : (k + 1) * BLOCK]
            if sums.any():
                yield pd.DataFrame([(k, salt, zlib.compress(sums.astype(np.int64).tobytes(), 1))], columns=["block", "part", "sums"])

    rows = spread(docs.select("text")).mapInPandas(run, "block int, part int, sums binary")

    def scaled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for block, data in zip(part["block"], part["sums"], strict=True):
                v = np.frombuffer(zlib.decompress(data), np.int64).reshape(BLOCK, DIM).astype(float)
                v = np.rint(127 * v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.int8)
                yield pd.DataFrame([(block, v.tobytes())], columns=["block", "v"])

    got = _sums(_sums(rows, "block", "part"), "block").mapInPandas(scaled, "block int, v binary").toArrow()
    out = np.zeros((-(-len(known) // BLOCK) * BLOCK, DIM), dtype=np.int8)
    for block, v in zip(got["block"].to_pylist(), got["v"].to_pylist(), strict=True):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(v, np.int8).reshape(BLOCK, DIM)
    return out[: len(known)]


def pooled(known: np.ndarray, vectors: np.ndarray, texts: list) -> np.ndarray:
    """A row for each text: mean vector of its different words, how many of its words are different, log of their number."""
    out = np.zeros((len(texts), DIM + 2), dtype=np.float32)
    for a, z in _batches(texts):
        h, doc = words(texts[a:z])
        n = np.bincount(doc, minlength=z - a)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = (np.diff(h, prepend=~h[:1]) != 0) | (np.diff(doc, prepend=-1) != 0)
        h, doc = h[first], doc[first]
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        mine = known[at] == h if len(known) else np.zeros(len(h), bool)
        place, sign = index_of(h[~mine])
        total = np.bincount((doc[~mine][:, None] * DIM + place).reshape(-1), sign.reshape(-1) / NONZERO**0.5, minlength=(z - a) * DIM).astype(float).reshape(-1, DIM)
        at, who = at[mine], doc[mine]
        for lo in range(0, len(at), 50_000):
            some = who[lo : lo + 50_000]
            cut = np.flatnonzero(np.diff(some, prepend=-1))
            total[some[cut]] += np.add.reduceat(vectors[at[lo : lo + 50_000]].astype(np.float32) / 127, cut, axis=0)
        different = np.bincount(doc, minlength=z - a)
        out[a:z, :DIM] = total / np.maximum(different, 1)[:, None]
        out[a:z, DIM] = different / np.maximum(n, 1)
        out[a:z, DIM + 1] = np.log1p(n)
    return out


@dataclass(frozen=True)
class Model:
    known: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def fit(known: np.ndarray, vectors: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, seed: int = 3) -> Model:
    """Full-batch Adam on three rows in four; the fourth sets the temperature. ``weight`` restores the labels' true shares."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    both = len(y) > 0 and y.any() and not y.all()
    if not both:
        share = 0.5 if not len(y) else (y.sum() + 1) / (len(y) + 2)
        return Model(known, vectors, mean, scale, p[0], p[1], 0 * p[2], float(np.log(share / (1 - share))))
    test = np.arange(len(y)) % 4 == 3
    z, t, c = np.clip((x - mean) / scale, -8, 8)[~test], y[~test], weight[~test] / weight[~test].sum()
    m, v = [0 * q for q in p], [0 * q for q in p]
    for k in range(1, rounds + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) * c
        back = np.outer(d, p[2]) * (1 - h * h)
        grad = [z.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
        for i, g in enumerate(grad):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-9)
    model = Model(known, vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, t, c = model.logit(x[test]), y[test], weight[test]
    loss = {s: float((np.logaddexp(0, np.where(t > 0, -logit, logit) / s) * c).sum()) for s in np.geomspace(0.25, 8, 41)}
    return Model(known, vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), float(min(loss, key=loss.get)))


def train(docs: DataFrame, learn: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Word vectors from all of ``docs`` (they use no label), the network from the labelled rows of ``learn``."""
    known = common_words(docs)
    vectors = word_vectors(docs, known)
    shared = docs.sparkSession.sparkContext.broadcast((known, vectors))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"y": part["y"], "h": part["h"], "x": [v.tobytes() for v in pooled(*shared.value, part["text"].tolist())]})

    rows = labelled(learn.select("doc_id", "text"), labels, "quality")
    shares = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # two labels
    picked = sampled(rows, per_label, "y").select("y", F.xxhash64("doc_id", "text").alias("h"), "text")
    got = picked.mapInPandas(run, "y int, h long, x binary").toArrow().to_pandas().sort_values(["h", "y"])
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]).astype(float) if len(got) else np.zeros((0, DIM + 2))
    label = got["y"].to_numpy()
    weight = np.array([shares[v] / max(1, (label == v).sum()) for v in label], dtype=float)
    return fit(known, vectors, x, (label > 0).astype(float), weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row; a null text counts as empty, repeated rows are scored alike."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            model = shared.value
            p = model.probability(pooled(model.known, model.vectors, part["text"].tolist()))
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": p, "predicted": (p >= 0.5).astype(int)})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn labels from rows whose crc32(doc_id) modulo ``folds`` is not ``held``, score every row.

    Columns of ``docs`` other than doc_id and text, whatever their names, play no part."""
    out = crc_mod(F.col("doc_id"), folds) == held
    scored = score(docs, train(docs, docs.where(~out), labels))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")
