"""Toxicity by class-conditional Kneser-Ney models over words: toxic against ordinary.

Each class has a bigram model whose discounts come from its counts of counts, D = n1 / (n1 + 2 n2):

    P_c(w | u) = max(n_c(u, w) - D_c, 0) / n_c(u) + L_c(u) P_c(w)       n_c: in how many texts w follows u
    P_c(w)     = max(k_c(w) - d_c, 0) / K_c + G_c P(w)                  k_c: after how many different words w stands
    P(w)       = max(k(w) - d, 0) / K + G / (V + 1)                     k: the same over both classes together

L, G: what the discounts leave, so that each sums to one over the V words and one unknown. The last line is shared: an
expression rare in both classes has nearly the same probability under either and is no evidence.

A text counts once for each of its bigrams: one page that repeats an expression a thousand times is one context.

A text's evidence is its log-likelihood under the toxic model less that under the ordinary one, normalised by length: per
word of the whole text, and per word of its ``WORST`` words (a long text may be toxic in one place); and the log of its
length. A logistic curve over these, fitted on labelled rows kept out of the counts, makes the score.

Counts come from every labelled training row, as rows that are combined and shuffled. An n-gram has a term of its own if a
class has it ``LEAST`` times (bigrams, words), the models' cutoff; others back off whole. Terms of n-grams that a class has once
in ``RARE`` of its own, at most ``RARE`` of each class, some 100 MB, reach the driver and are broadcast. If there are more terms,
the others stay a table, and the bigrams that the broadcast terms leave open are joined with it: every term counts, at every size.
Words are 32-bit hashes. The calibration takes about ``CALIBRATION`` rows of each label (those of lowest id hash).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import crc_mod, keep, labelled, lookup, sampled, spread
from pathloom.llm.rolling import word_hashes

LEAST, RARE, CALIBRATION, WORST, CHUNK = (20, 5), 2_000_000, 4000, (1, 2, 5), 1_000_000
FEATURES = len(WORST) + 2
START = 1  #: stands before the first word of a text
CLASSES = ("t", "o")


def bigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Of every word: its bigram (the word before it times 2**32, plus the word) and its text's number."""
    h, text = word_hashes(texts)
    w = h >> np.uint64(32)
    u = np.append(np.uint64(START), w[:-1])
    u[np.diff(text, prepend=-1) != 0] = START
    return (u << np.uint64(32)) | w, text


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


def count_bigrams(rows: DataFrame) -> DataFrame:
    """key, t, o: how many ``rows(text, y)`` of each kind have the bigram."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, y = part["text"].tolist(), part["y"].to_numpy() > 0
            for a, z in _batches(texts):
                key, text = bigrams(texts[a:z])
                order = np.lexsort((text, key))
                key, text = key[order], text[order]
                once = (np.diff(key, prepend=~key[:1]) != 0) | (np.diff(text, prepend=-1) != 0)
                key, at = np.unique(key[once], return_inverse=True)
                toxic = np.bincount(at[y[a:z][text[once]]], minlength=len(key))
                yield pd.DataFrame({"key": key.view(np.int64), "t": toxic, "o": np.bincount(at, minlength=len(key)) - toxic})

    counted = rows.select("text", "y").mapInPandas(run, "key long, t long, o long")
    return counted.groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _discount(n1: int, n2: int) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _own(counts: list[str], least: int) -> Column:
    """Whether an n-gram has a term of its own."""
    return F.greatest(*counts) >= least


def _often(counts: dict[str, str], totals: dict[str, int]) -> Column:
    """Whether an n-gram's term is broadcast if not all are."""
    out = F.lit(False)
    for c, name in counts.items():
        out = out | (F.col(name) >= max(1, -(-totals[c] // RARE)))
    return out


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios: of bigrams (whole), of what is left to back-off after a word, of words; others have ``unknown``.

    ``rest`` has the terms (k, x) that are not in the arrays, in the same order, if there are any."""

    bigram: tuple[np.ndarray, np.ndarray]
    after: tuple[np.ndarray, np.ndarray]
    word: tuple[np.ndarray, np.ndarray]
    unknown: float
    curve: tuple[float, ...] = (0.0,) * (FEATURES + 1)
    rest: tuple[DataFrame, ...] | None = None

    def ratios(self, key: np.ndarray) -> np.ndarray:
        found, whole = _find(self.bigram, key, 0.0)
        left = _find(self.after, key >> np.uint64(32), 0.0)[1] + _find(self.word, key & np.uint64(0xFFFFFFFF), self.unknown)[1]
        return np.where(found, whole, left)

    def split(self, text) -> tuple[int, float, list[float], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of a text; sum and greatest ratios of those whose bigram has a term here; the other bigrams, how often they
        stand, and the parts that the words before and the words have here (NaN: none here)."""
        key, _ = bigrams([text])
        key, times = np.unique(key, return_counts=True)
        here, whole = _find(self.bigram, key, 0.0)
        top = np.sort(np.repeat(whole[here], np.minimum(times[here], WORST[-1])))[::-1][: WORST[-1]]
        left, m = key[~here], times[~here]
        after, word = _find(self.after, left >> np.uint64(32), np.nan)[1], _find(self.word, left & np.uint64(0xFFFFFFFF), np.nan)[1]
        return int(times.sum()), float(whole[here] @ times[here]), top.tolist(), left.view(np.int64), m, after.astype(float), word.astype(float)

    def evidence(self, texts: list) -> np.ndarray:
        """Of each text: ratio per word of the whole and of its worst words, log of its length; 0 for a text without words."""
        out = np.zeros((len(texts), FEATURES))
        for a, z in _batches(texts):
            key, text = bigrams(texts[a:z])
            ratio = self.ratios(key)
            n = np.bincount(text, minlength=z - a)
            out[a:z, 0] = np.bincount(text, ratio, minlength=z - a) / np.maximum(n, 1)
            order = np.lexsort((-ratio, text))
            ratio, nth = ratio[order], np.arange(len(key)) - (np.cumsum(n) - n)[text]  # text ascends
            for j, k in enumerate(WORST, 1):
                out[a:z, j] = np.bincount(text[nth < k], ratio[nth < k], minlength=z - a) / np.maximum(np.minimum(n, k), 1)
            out[a:z, -1] = np.log1p(n)
        return out


def _find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and its value or ``other``."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(key), bool), np.full(len(key), other)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    there = keys[at] == key
    return there, np.where(there, values[at], other)


def kneser_ney(counts: DataFrame) -> Model:
    """The model of ``counts(key, t, o)``."""
    u, w = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    x = counts.agg(*[F.sum(c).alias(c) for c in CLASSES], *[F.count_if(F.col(c) == i).alias(f"{c}{i}") for c in CLASSES for i in (1, 2)]).first()
    total = {c: x[c] or 0 for c in CLASSES}
    d2 = {c: _discount(x[f"{c}1"], x[f"{c}2"]) for c in CLASSES}
    own, often = _own(list(CLASSES), LEAST[0]), _often({c: c for c in CLASSES}, total)
    less = {c: F.when(own, F.greatest(F.col(c) - F.lit(d2[c]), F.lit(0.0))).otherwise(0.0) for c in CLASSES}

    after = counts.groupBy(u.alias("u")).agg(*[F.sum(c).alias(f"n_{c}") for c in CLASSES], *[F.sum(less[c]).alias(f"x_{c}") for c in CLASSES], F.max(own).alias("some")).where("some")
    left = lambda c: F.when(F.col(f"n_{c}") > 0, 1 - F.col(f"x_{c}") / F.col(f"n_{c}")).otherwise(1.0)
    after = keep(after.select("u", *[f"n_{c}" for c in CLASSES], *[left(c).alias(f"l_{c}") for c in CLASSES], _often({c: f"n_{c}" for c in CLASSES}, total).alias("often")))

    words = keep(counts.groupBy(w.alias("w")).agg(*[F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in CLASSES], F.count("*").alias("k")))
    y = words.agg(F.count("*").alias("v"), *[F.sum(f"k{e}").alias(f"k{e}") for e in ("", "_t", "_o")], *[F.count_if(F.col(f"k{e}") == i).alias(f"k{e}{i}") for e in ("", "_t", "_o") for i in (1, 2)]).first()
    types = {e: y[f"k{e}"] or 0 for e in ("", "_t", "_o")}
    d1 = {e: _discount(y[f"k{e}1"], y[f"k{e}2"]) for e in types}
    kept = _own(["k_t", "k_o"], LEAST[1])
    cut = {e: F.greatest(F.col(f"k{e}") - F.lit(d1[e]), F.lit(0.0)) / max(1, types[e]) for e in types}
    mass = words.where(kept).agg(*[F.coalesce(F.sum(cut[e]), F.lit(0.0)).alias(f"m{e}") for e in types]).first()
    remain = {e: 1 - mass[f"m{e}"] for e in types}
    base = remain[""] / (y.v + 1)
    shared = cut[""] + base
    named = words.where(kept).select("w", _often({"_t": "k_t", "_o": "k_o"}, types).alias("often"), *[(cut[f"_{c}"] + F.lit(remain[f"_{c}"]) * shared).alias(f"p_{c}") for c in CLASSES])

    two = counts.where(own).select("key", u.alias("u"), w.alias("w"), often.alias("common"), *CLASSES).join(after, "u").join(named, "w", "left")
    part = {c: F.coalesce(F.try_divide(F.greatest(F.col(c) - F.lit(d2[c]), F.lit(0.0)), F.col(f"n_{c}")), F.lit(0.0)) for c in CLASSES}
    p = {c: part[c] + F.col(f"l_{c}") * F.coalesce(f"p_{c}", F.lit(remain[f"_{c}"] * base)) for c in CLASSES}
    log = lambda a, b: (F.ln(a) - F.ln(b)).cast("float").alias("x")

    def table(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toArrow()
        keys, values = got["k"].to_numpy().view(np.uint64), got["x"].to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    terms = two.select(F.col("key").alias("k"), log(p["t"], p["o"]), F.col("common").alias("often")), after.select(F.col("u").alias("k"), log(F.col("l_t"), F.col("l_o")), "often"), named.select(F.col("w").alias("k"), log(F.col("p_t"), F.col("p_o")), "often")
    terms = tuple(keep(x) for x in terms)
    all_fit = max(x.count() for x in terms) <= len(CLASSES) * RARE
    rest = None if all_fit else tuple(x.where("not often").select("k", "x") for x in terms)
    unknown = float(np.log(remain["_t"] / remain["_o"])) if remain["_t"] > 0 < remain["_o"] else 0.0
    return Model(*(table(x if all_fit else x.where("often")) for x in terms), unknown, rest=rest)


def _joined(rows: DataFrame, model: Model, *extra: str) -> DataFrame:
    """``extra`` and x (the evidence) of every row, with the terms that are not broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40  # a number for each row
        for part in parts:
            got = [shared.value.split(t) for t in part["text"]]
            out = part[list(extra)].assign(row=np.arange(row, row + len(part)))
            for i, name in enumerate(("n", "total", "top", "keys", "times", "a", "b")):
                out[name] = [x[i] for x in got]
            row += len(part)
            yield out

    cols = "".join(f"`{k}` {kinds[k]}, " for k in extra)
    base = keep(rows.select(*extra, "text").mapInPandas(run, cols + "row long, n long, total double, top array<double>, keys array<long>, times array<long>, a array<double>, b array<double>"))
    open_ = base.select("row", F.explode(F.arrays_zip("keys", "times", "a", "b")).alias("z")).select("row", F.col("z.keys").alias("key"), F.col("z.times").alias("m"), *(F.when(~F.isnan(f"z.{c}"), F.col(f"z.{c}")).alias(c) for c in "ab"))
    bigram, after, word = (x.withColumnsRenamed({"k": f"k{i}", "x": f"x{i}"}) for i, x in enumerate(model.rest))
    found = open_.groupBy("key").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("size")).join(bigram, F.col("key") == F.col("k0"), "left")
    of = {"a": (after, "1", F.shiftrightunsigned("key", 32), 0.0), "b": (word, "2", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), model.unknown)}
    for c, (table, i, k, other) in of.items():
        found = keep(found)  # only keys without a term at hand are looked up
        none = F.col("x0").isNull() & F.col(c).isNull()
        looked = found.where(none).join(table, k == F.col(f"k{i}"), "left").withColumn(c, F.coalesce(F.col(f"x{i}").cast("double"), F.lit(other))).select(*found.columns)
        found = found.where(~none).unionByName(looked)
    values = keep(found.select("key", F.coalesce(F.col("x0").cast("double"), F.col("a") + F.col("b")).alias("x"), "size"))
    each = lookup(open_, values, ["key"], "size")
    most = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("x", F.least("m", F.lit(WORST[-1])).cast("int")))), False), 1, WORST[-1])
    more = each.groupBy("row").agg(F.sum(F.col("x") * F.col("m")).alias("more"), most.alias("most"))
    both = base.join(more, "row", "left")
    top = F.slice(F.sort_array(F.concat("top", F.coalesce("most", F.array().cast("array<double>"))), False), 1, WORST[-1])
    both = both.select(*extra, "n", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), top.alias("top"))
    mean = lambda k: F.aggregate(F.slice("top", 1, k), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.least("n", F.lit(k)), F.lit(1))
    return both.select(*extra, F.array(F.col("total") / F.greatest("n", F.lit(1)), *[mean(k) for k in WORST], F.log1p("n")).alias("x"))


def _evidence(rows: DataFrame, model: Model, *extra: str) -> DataFrame:
    if model.rest is not None:
        got = _joined(rows, model, *extra)
        z = sum((F.col("x")[i] * F.lit(float(w)) for i, w in enumerate(model.curve[:-1])), F.lit(float(model.curve[-1])))
        return got.select(*extra, "x", F.col("x")[0].alias("per_word"), (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias("score"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        curve = np.array(shared.value.curve)
        for part in parts:
            x = shared.value.evidence(part["text"].tolist())
            z = x @ curve[:-1] + curve[-1]
            yield part[list(extra)].assign(x=list(x), per_word=x[:, 0], score=1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return rows.select(*extra, "text").mapInPandas(run, "".join(f"`{k}` {kinds[k]}, " for k in extra) + "x array<double>, per_word double, score double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by Newton's method on standardised columns."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
    out = w[:-1] / sd
    return np.append(out, w[-1] - out @ mean)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, calibration: int = CALIBRATION) -> Model:
    """Fit on the labelled rows of ``docs``; those whose id's crc32 is ``folds - 1`` modulo ``folds`` calibrate.

    Rows that repeat a document count each. Without labels of both kinds the curve is flat: the labels' mean, or one half."""
    rows = labelled(docs.select("doc_id", "text"), labels, "toxic")
    last = crc_mod(F.col("doc_id"), folds) == folds - 1
    model = kneser_ney(keep(count_bigrams(rows.where(~last))))
    picked = sampled(rows.where(last), calibration, "y").withColumn("h", F.xxhash64("doc_id", "text"))
    held = _evidence(picked, model, "y", "h").toArrow().to_pandas().sort_values(["h", "y"])
    y = held["y"].to_numpy() > 0
    if not y.any() or y.all():
        flat = 0.5 if not len(y) else (y.sum() + 1) / (len(y) + 2)
        return replace(model, curve=(0.0,) * FEATURES + (float(np.log(flat / (1 - flat))),))
    return replace(model, curve=tuple(logistic(np.stack(held["x"]), y.astype(float)).tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, per_word (the ratio per word of the whole text) for every row; null and empty texts score as a text without evidence."""
    out = _evidence(spread(docs.select("doc_id", "text")), model, "doc_id")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "per_word")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id) modulo ``folds`` is not ``held``, score every row.

    Columns of ``docs`` other than doc_id and text, whatever their names, play no part."""
    out = crc_mod(F.col("doc_id"), folds) == held
    scored = score(docs, train(docs.where(~out), labels, folds))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted", "per_word")
