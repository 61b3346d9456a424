"""Feature-hash embeddings: signed sums of weighted tokens and token pairs, FNV-1a over UTF-16 code units.

A document's features and their sums need no other document, so this is a narrow Arrow stage: no shuffle at all."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
TOKEN = re.compile(r"[^\W_]+")
MIN_DIM, MAX_DIM = 32, 4096


def fnv1a64(texts: list[str]) -> np.ndarray:
    """64-bit FNV-1a of each text's UTF-16 code units (each unit is one step), as signed longs."""
    return _Units(texts).after(np.full(len(texts), OFFSET, dtype=np.uint64), np.arange(len(texts))).view(np.int64)


class _Units:
    """The UTF-16 code units of some texts."""

    def __init__(self, texts: list[str]) -> None:
        data = [t.encode("utf-16-le", "surrogatepass") for t in texts]
        self._size = np.array([len(d) // 2 for d in data], dtype=np.int64)
        self._units = np.frombuffer(b"".join(data), dtype="<u2").astype(np.uint64)
        self._start = np.cumsum(self._size) - self._size

    def after(self, states: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Each state, carried on over the units of the text with this number."""
        size = self._size[which]
        most = int(size.max()) if len(size) else 0
        order = np.argsort((most - size).astype(np.uint16 if most < 2**16 else np.int64), kind="stable")  # those that still have units stay in front
        alive = np.searchsorted(-size[order], -np.arange(most), side="left")
        out, at = states[order], self._start[which][order]
        for i, n in enumerate(alive.tolist()):
            out[:n] = (out[:n] ^ self._units[at[:n] + i]) * PRIME
        back = np.empty_like(out)
        back[order] = out
        return back


def fnv1a64_native(text: Column) -> Column:
    """The same hash as a Catalyst expression: two 32-bit halves, since a long product would overflow."""
    bytes_ = F.hex(F.encode(text, "UTF-16BE"))
    steps = F.when(F.length(bytes_) > 0, F.sequence(F.lit(0), (F.length(bytes_) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    unit = lambda i: F.conv(F.substring(bytes_, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    word = F.lit(0xFFFFFFFF).cast("long")

    def step(s: Column, i: Column) -> Column:
        x = s["lo"].bitwiseXOR(unit(i))
        p = x * 435
        return F.struct((s["hi"] * 435 + F.shiftright(p, 32) + F.shiftleft(x, 8)).bitwiseAND(word).alias("hi"), p.bitwiseAND(word).alias("lo"))

    first = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))
    return F.aggregate(steps, first, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))


def features(instruction: str | None, actions, extra: str | None = None) -> tuple[list[str], list[float]]:
    """Tokens and pairs of neighbouring tokens of each text, with weights; pairs do not cross texts."""
    names, weights = [], []
    first = f"{instruction or ''} {extra}" if extra is not None else instruction or ""
    for space, weight, text in [("instruction", 2.0, first), *(("action", 1.0, a) for a in (actions if actions is not None else []))]:
        tokens = TOKEN.findall((text or "").lower())
        names += [f"{space}:{t}" for t in tokens] + [f"{space}:bigram:{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False)]
        weights += [weight] * len(tokens) + [weight / 2] * max(0, len(tokens) - 1)
    return names, weights


def _check(dim: int) -> None:
    if not MIN_DIM <= dim <= MAX_DIM:
        raise ValueError(f"dimension must be {MIN_DIM} to {MAX_DIM}")


def sums(names: list[str], weights: list[float], dim: int) -> np.ndarray:
    """The signed sum of each bucket (multiples of one half, so their order is of no account)."""
    h = fnv1a64(names)
    return np.bincount(np.mod(h, dim), np.where(h >= 0, weights, np.negative(weights)), minlength=dim) if names else np.zeros(dim)


def unit(vector: np.ndarray) -> np.ndarray:
    """Float vector of length one; the first unit vector for zero."""
    length = np.float32(np.sqrt(np.sum(vector * vector)))
    if not length:
        return np.eye(1, len(vector), dtype=np.float32)[0]
    return (vector.astype(np.float32) / length).astype(np.float32)


#: Rows whose sums are made together: rows x dimension numbers in memory.
ROWS = 1024


class _Codes(dict):
    """A number for each different token."""

    def __missing__(self, token: str) -> int:
        self[token] = len(self)
        return self[token]


def batch_sums(rows: list[tuple], dim: int) -> np.ndarray:
    """The sums of each (instruction, app, actions), those of ``features``. A pair's hash goes on from that of its first token, so
    that each different token is encoded once and no pair is ever a string."""
    codes, found = _Codes(), {}
    for i, (text, app, actions) in enumerate(rows):
        first = f"{text or ''} {app}" if app is not None else text or ""
        for space, said in [("instruction", first), *(("action", a) for a in (actions if actions is not None else []))]:
            tokens = TOKEN.findall((said or "").lower())
            if tokens:
                found.setdefault(space, []).append((i, np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))))
    out, units = np.zeros(len(rows) * dim), _Units(list(codes))
    for space, weight in (("instruction", 2.0), ("action", 1.0)):
        if space not in found:
            continue
        each = [len(c) for _, c in found[space]]
        token, who = np.concatenate([c for _, c in found[space]]), np.repeat([i for i, _ in found[space]], each)
        start = fnv1a64([f"{space}:", f"{space}:bigram:"]).view(np.uint64)
        every = np.arange(len(codes))
        alone = units.after(np.full(len(codes), start[0]), every)
        left = (units.after(np.full(len(codes), start[1]), every) ^ np.uint64(ord("_"))) * PRIME
        paired = np.ones(len(token), bool)
        paired[np.cumsum(each) - 1] = False
        at = np.flatnonzero(paired)
        for h, row, w in ((alone[token], who, weight), (units.after(left[token[at]], token[at + 1]), who[at], weight / 2)):
            h = h.view(np.int64)
            out += np.bincount(row * dim + np.mod(h, dim), np.where(h >= 0, w, -w), minlength=len(out))
    return out.reshape(len(rows), dim)


def _columns(part, names) -> list[tuple]:
    return list(zip(*[part.column(n).to_pylist() for n in names], strict=True))


INPUTS = ("instruction", "app", "actions")


def hash_features(df: DataFrame, dim: int = 256) -> DataFrame:
    """(id, bucket, value): the non-zero sums for ``df(id, instruction, app, actions)``; null app: instruction alone."""
    _check(dim)
    kind = dict(df.dtypes)["id"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                v = batch_sums(_columns(some, INPUTS), dim)
                who, bucket = np.nonzero(v)
                yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(who)), pa.array(bucket.astype(np.int32)), pa.array(v[who, bucket])], ["id", "bucket", "value"])

    return df.select("id", *INPUTS).mapInArrow(run, f"id {kind}, bucket int, value double")


def with_hash_embedding(df: DataFrame, dim: int = 256) -> DataFrame:
    """``df`` with its embedding replaced; every other column comes through, so nothing is joined or shuffled."""
    _check(dim)
    rows = df.drop("embedding")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                v = batch_sums(_columns(some, INPUTS), dim)
                length = np.sqrt((v * v).sum(axis=1)).astype(np.float32)
                v = v.astype(np.float32) / np.where(length == 0, np.float32(1), length)[:, None]
                v[length == 0, 0] = 1
                lists = pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), dim).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], [*some.schema.names, "embedding"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def hash_embedding(df: DataFrame, dim: int = 256) -> DataFrame:
    """(id, embedding): the sums scaled to length one; the first unit vector for none."""
    return with_hash_embedding(df.select("id", *INPUTS), dim).select("id", "embedding")
