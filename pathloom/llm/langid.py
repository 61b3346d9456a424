"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary logistic classifier over hashed byte n-grams predicts whether the
text's language has it set. Decoding adds up, over the bits, the loss each classifier would have if the codeword were
right, weighted by how reliable the bit was in training, and takes the nearest codeword. A small gap to the second
nearest flags the text as ambiguous.

Fitted on the driver from about ``PER_LANG`` documents of each language, ``SAMPLE`` in all (with more languages than that
one of each), those with the lowest id hash: the bound on what is gathered. Every document is scored over its whole text.

The distance to the nearest codeword also tells how far a text is from everything learned. Beyond ``SLACK`` times the
distance that all but one in a thousand of the sample's held-out quarter keep, and beyond that of a text of which no
classifier knows anything, a text of ``SURE`` letters or more is rejected: it is in none of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import crc_mod, sampled, spread

CELLS, PER_LANG, SAMPLE, GAP, SLACK, SURE, PIECE = 2048, 600, 12_000, 0.5, 3.0, 20, 1 << 20
UNKNOWN = "und"


def features(texts: list[str | None]) -> np.ndarray:
    """A row for each text: square roots of hashed 1- to 3-gram counts of its lower-case bytes, scaled to length one.

    Texts are counted in pieces of ``PIECE`` characters that overlap by two, so a long one needs no more memory."""
    out = np.zeros((len(texts), CELLS), dtype=np.float32)
    for row, text in enumerate(texts):
        text, n = f" {text or ''} ", np.zeros(CELLS)
        tail = np.zeros(0, dtype=np.uint32)
        for at in range(0, len(text), PIECE):
            b = np.concatenate((tail, np.frombuffer(text[at : at + PIECE].lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)))
            two = b[:-1] | (b[1:] << np.uint32(8))
            three = two[:-1] | (b[2:] << np.uint32(16))
            for k, code in enumerate((b[len(tail) :], two[max(0, len(tail) - 1) :], three)):
                n += np.bincount(((code + np.uint32(0x1000003 * k)) * np.uint32(2654435769)) >> np.uint32(21), minlength=CELLS)
            tail = b[-2:]
        n = np.sqrt(n)
        out[row] = n / np.linalg.norm(n)
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: every split of up to 5 languages, else splits drawn with a fixed seed, all rows apart."""
    if n <= 5:
        cols = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, dtype=np.int8).T.reshape(n, len(cols))
    rng, bits = np.random.default_rng(5), max(15, int(np.ceil(10 * np.log2(n))))
    return max((rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(50)), key=lambda c: min(((c[i] != c[i + 1 :]).sum(1).min() for i in range(n - 1))))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  #: (CELLS, bits)
    bias: np.ndarray
    trust: np.ndarray  #: of each bit
    limit: float = np.inf  #: of the distance to the nearest codeword

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language, its score, whether the answer is ambiguous, and the distance."""
        if not self.codes.shape[1]:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool), np.zeros(len(x))
        margin = x @ self.weights + self.bias
        far = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.codes], axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        rows = np.arange(len(x))
        gap = far[rows, order[:, 1]] - far[rows, order[:, 0]]
        p = np.exp(far.min(axis=1, keepdims=True) - far)
        return order[:, 0], 1 / p.sum(axis=1), gap < GAP, far.min(axis=1)


def fit(x: np.ndarray, langs: list[str], rounds: int = 150) -> Model:
    names = sorted(set(langs))
    codes = codewords(len(names))
    at = np.array([names.index(v) for v in langs], dtype=int)
    y, share = codes[at].astype(np.float32), np.bincount(at, minlength=len(names)).astype(np.float32)
    weight = (len(at) / (len(names) * share))[at][:, None] / max(1, len(at))  # languages count alike
    w, b = np.zeros((CELLS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    mw, mb, step = w.copy(), b.copy(), 20.0
    for _ in range(rounds if codes.shape[1] else 0):
        g = -y * weight / (1 + np.exp(y * (x @ w + b)))
        mw, mb = 0.9 * mw - step * (x.T @ g + 1e-5 * w), 0.9 * mb - step * g.sum(axis=0)
        w, b = w + mw, b + mb
    right = ((y * (x @ w + b) > 0) * weight).sum(axis=0)
    return Model(names, codes, w, b, np.clip(2 * right - 1, 0.05, 1))


def fit_with_limit(x: np.ndarray, langs: list[str]) -> Model:
    """``fit``, with the limit of rejection from every fourth row under a model of the other three."""
    test = np.arange(len(langs)) % 4 == 3
    model, seen = fit(x, langs), set(np.array(langs, dtype=object)[~test])
    test &= np.array([v in seen for v in langs])
    if test.sum() < 20:
        return model
    far = fit(x[np.arange(len(langs)) % 4 != 3], [v for i, v in enumerate(langs) if i % 4 != 3]).decode(x[test])[3]
    return replace(model, limit=max(SLACK * float(np.quantile(far, 0.999)), float(np.log(2) * model.trust.sum())))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Fit on ``docs(doc_id, text, lang)``; None where no row has both text and lang."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    per_lang = max(1, min(per_lang, SAMPLE // max(1, rows.select("lang").distinct().count())))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = features(list(part["text"]))
            yield pd.DataFrame({"lang": part["lang"], "h": part["h"], "x": [v.astype(np.float16).tobytes() for v in x]})

    picked = sampled(rows, per_lang, "lang").withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    got = picked.select("lang", "text", "h").mapInPandas(run, "lang string, h long, x binary").toArrow().to_pandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "h"])
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32)
    return fit_with_limit(x, got["lang"].tolist())


def predict(model: Model | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text, and whether it is rejected: no letter, or far from every language."""
    some = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))]
    lang, score, vague, out = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.ones(len(texts), bool), np.ones(len(texts), bool)
    if model is None:
        out[some] = False
        return lang, score, vague, out
    for at in range(0, len(some), 256):
        rows = some[at : at + 256]
        best, score[rows], vague[rows], far = model.decode(features([texts[i] for i in rows]))
        lang[rows] = [model.langs[i] for i in best]
        out[rows] = [d > model.limit and sum(map(str.isalpha, texts[i])) >= SURE for i, d in zip(rows, far.tolist(), strict=True)]
    return lang, score, vague, out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, rejected, for every row of ``docs(doc_id, text)``.

    ``und`` with score 0 for a text that is null or has no letter, and for all if there is no model. Repeated rows are
    judged alike; other columns of ``docs``, whatever their names, are left out.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lang, score, vague, out = predict(shared.value, part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": lang, "score": score, "ambiguous": vague, "rejected": out})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean, rejected boolean")


def predict_languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Train on the rows whose crc32(doc_id) modulo ``folds`` is not ``held``, predict for all."""
    out = crc_mod(F.col("doc_id"), folds) == held
    model = train(docs.where(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous", "rejected")


def keep_identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs`` with a language: those of null text, without a letter, or rejected as far from every language go.

    If nothing could be learned, all with a letter stay. Rows are kept as they are, repeated ones each, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(crc_mod(F.col("doc_id"), folds) != held)))
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(~predict(shared.value, part.column(at).to_pylist())[3]))

    return docs.mapInArrow(run, docs.schema)
