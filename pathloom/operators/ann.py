"""Approximate neighbours: an inverted file. Unit vectors belong to the cell of the nearest centre; a query looks into the
cells of its nearest centres only, and what stands there is scored exactly, block by block. A query stays one row, however many
cells it looks into.

Centres are spherical k-means over a bounded sample (``SAMPLE`` rows of lowest id hash); every row is indexed. Hot cells are
no hot spot: a cell is as many blocks as it needs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.knn import knn_join
from pathloom.scratch import keep

EXACT_BELOW, SAMPLE, ROUNDS, PROBES = 128, 20_000, 8, 0.7


@dataclass(frozen=True)
class Cells:
    """The centres, and the corpus with a column ``cell``."""

    centres: np.ndarray
    corpus: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centres_of(x: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Spherical k-means: ``cells`` unit vectors."""
    x = _unit(x.astype(np.float32))
    centre = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(np.bincount(near, minlength=len(centre))[:, None] > 0, _unit(sums), centre)
    return centre


def _nearest(df: DataFrame, centres: np.ndarray, probes: int | None = None) -> DataFrame:
    """``df`` with ``cell``, or with the array ``cells`` of the ``probes`` nearest."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # sqrt(SAMPLE) rows at most
    at = df.columns.index("embedding")
    name, kind = ("cell", T.IntegerType()) if probes is None else ("cells", T.ArrayType(T.IntegerType()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x, n = np.array(part.column(at).to_pylist(), dtype=np.float32), probes or 1
            near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :n] if len(shared.value) > 1 else np.zeros((len(x), 1))
            flat = pa.array(near.reshape(-1).astype(np.int32))
            cells = flat if probes is None else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*part.columns, cells], [*part.schema.names, name])

    return df.where("embedding is not null").mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def build(corpus: DataFrame, cells: int | None = None, seed: int = 42) -> Cells:
    """Fit the centres, the root of the sample's size unless given, and place every row of ``corpus(id, embedding, ...)``."""
    some = corpus.where("embedding is not null").select("embedding", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE).select("embedding")
    x = np.array([r.embedding for r in some.collect()], dtype=np.float32)
    centres = centres_of(x, cells or max(1, int(len(x) ** 0.5)), seed) if len(x) else np.zeros((1, 1), np.float32)
    return Cells(centres, keep(_nearest(corpus, centres)) if len(x) else corpus.withColumn("cell", F.lit(0)))


def approximate_neighbours(model: Cells, queries: DataFrame, corpus: DataFrame | None = None, k: int = 10, probes: float = PROBES) -> DataFrame:
    """(qid, id, cos, rank) among the rows in the ``probes`` share of cells nearest to each query. ``corpus``: only these rows."""
    rows = model.corpus if corpus is None else _nearest(corpus.select("id", "embedding"), model.centres)
    asked = _nearest(queries.select("qid", "embedding"), model.centres, max(1, round(probes * len(model.centres))))
    return knn_join(asked, rows.select("id", "embedding", "cell"), k=k, cells=len(model.centres))
