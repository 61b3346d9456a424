"""Vectors packed a few thousand to a row, and the pairs of such rows.

Packed blocks are written once to the shared folder. Every task of ``meet`` reads its share of both sides from there, so
that pairs of blocks are neither shuffled nor written: what is moved grows with the rows, whatever the number of pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.scratch import keep

#: Rows of a block, bytes of its vectors, rows of it whose products are made together; bytes of a task's share that is held in memory.
BLOCK, BYTES, TILE, SHARE = 4096, 4 << 20, 512, 64 << 20
#: Rows that are scored exactly together.
EXACT = 4096


def block_rows(dimension: int | None, block: int = BLOCK) -> int:
    return max(1, min(block, BYTES // (4 * max(1, dimension or 1))))


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def files(spark: SparkSession, rows: int, dimension: int, block: int) -> int:
    """Into how many files blocks are written: enough for every core, none over ``SHARE`` bytes or so."""
    return max(1, min(-(-rows // block), 4 * cores(spark)), -(-rows * dimension * 4 // SHARE))


def pack(df: DataFrame, block: int, copies: int | None = None, carry: Sequence[str] = (), cells: int = 0, order: str | None = None) -> DataFrame:
    """Blocks of ``df(gid, part, id, embedding, *carry)``, which has rows of equal gid and part together.

    A block has ids and carried columns as lists, and x and len, the vectors as floats and their lengths as doubles, as bytes.
    Of rows with equal vectors and carried columns, if they are neighbours, the first ``copies`` stay. A column ``cells`` (with
    numbers under ``cells``) becomes a bit for each cell and row. ``order``: the carried column that the rows are sorted by, over all
    partitions; pos has numbers in this order, equal ones for equal values, lo and hi are a block's first and last."""
    lists = ["id", *carry]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    extra = [T.StructField("cells", T.BinaryType())] if cells else []
    extra += [T.StructField("pos", T.BinaryType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())] if order else []
    schema = T.StructType([
        T.StructField("gid", T.LongType()), T.StructField("part", T.LongType()), T.StructField("nth", T.IntegerType()),
        *[T.StructField(n, T.ArrayType(kinds[n])) for n in lists], T.StructField("len", T.BinaryType()), T.StructField("x", T.BinaryType()), *extra,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at, nth = [], 0, None, 0
        numbers = _Numbers(lists.index(order)) if order else None
        for batch in batches:
            gid, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "part"))
            start = 0
            while start < batch.num_rows:
                here = (int(gid[start]), int(part[start]))
                if held and (here != at or n >= block):
                    yield _packed(held, at, nth, lists, copies, cells, numbers)
                    held, n, nth = [], 0, nth + 1
                at = here
                other = (gid[start:] != here[0]) | (part[start:] != here[1])
                size = int(other.argmax()) if other.any() else len(other)
                size = min(size, block - n)
                held.append(batch.slice(start, size))
                start, n = start + size, n + size
        if held:
            yield _packed(held, at, nth, lists, copies, cells, numbers)

    columns = ["gid", "part", *lists, "embedding", *(["cells"] if cells else [])]
    return keep(df.select(*columns).mapInArrow(run, schema), {"parquet.block.row.count.limit": "8"})


class _Numbers:
    """Numbers of sorted values, those of a partition after those of the one before it."""

    def __init__(self, column: int) -> None:
        self.column, self._next, self._last = column, TaskContext.get().partitionId() << 40, None

    def of(self, values: list) -> np.ndarray:
        new = np.array([a != b for a, b in zip(values, [self._last, *values[:-1]], strict=True)])
        out = self._next + np.cumsum(new)
        self._next, self._last = int(out[-1]), values[-1]
        return out.astype(np.int64)


def _packed(held: list[pa.RecordBatch], at: tuple[int, int], nth: int, lists: list[str], copies: int | None, cells: int, numbers: _Numbers | None) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    vectors = rows.column("embedding").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if len(set(size.tolist())) > 1:
        raise ValueError(f"vectors of {sorted(set(size.tolist()))} dimensions in one block")
    x = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(size), int(size[0]))
    if copies is not None and len(x) > copies:
        stay = _first_copies(rows, x, lists[1:], copies)
        if len(stay) < len(x):
            rows, x = rows.take(pa.array(stay)), x[stay]
    x, length = _lengths(x)
    n = len(x)
    out = [pa.array([v]) for v in at] + [pa.array([nth], pa.int32())]
    for name in lists:
        values = rows.column(name).combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        out.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values))
    out += [pa.array([length.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
    names = ["gid", "part", "nth", *lists, "len", "x"]
    if cells:
        near = rows.column("cells").combine_chunks()
        near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
        bits = np.zeros((cells, n), bool)
        bits[near.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), pc.list_value_length(near).to_numpy(zero_copy_only=False))] = True
        out.append(pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()))
        names.append("cells")
    if numbers:
        pos = numbers.of(rows.column(lists[numbers.column]).to_pylist())
        out += [pa.array([pos.tobytes()], pa.binary()), pa.array([int(pos[0])]), pa.array([int(pos[-1])])]
        names += ["pos", "lo", "hi"]
    return pa.RecordBatch.from_arrays(out, names)


def _first_copies(rows: pa.Table, x: np.ndarray, names: list[str], copies: int) -> np.ndarray:
    same = (x[1:] == x[:-1]).all(axis=1)
    for name in names:
        v = np.array(rows.column(name).to_pylist(), dtype=object)
        same &= v[1:] == v[:-1]
    first = np.flatnonzero(np.r_[True, ~same])
    place = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
    return np.flatnonzero(place < copies)


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and their lengths, summed in index order. Very long and very short ones are scaled by a power of two, which
    leaves every cosine as it is and keeps float products from overflow."""
    if not x.shape[1]:
        return x, np.zeros(len(x))
    most = np.abs(x).max(axis=1).astype(float)
    far = np.flatnonzero((most > 2.0**40) | ((most < 2.0**-40) & (most > 0)))
    if len(far):
        x = x.copy()
        x[far] = np.ldexp(x[far].astype(float), -np.frexp(most[far])[1][:, None]).astype(np.float32)
    return x, np.sqrt(np.concatenate([np.cumsum(v.astype(float) ** 2, axis=1)[:, -1] for v in np.array_split(x, -(-len(x) // EXACT))]))


class Block:
    """One side of a pair of blocks, as sent to Python."""

    def __init__(self, part: pa.StructArray | pa.RecordBatch, side: str, row: int, dimension: int) -> None:
        self._part, self._side, self._row = part, side, row
        self.x = np.frombuffer(self._bytes("x"), np.float32).reshape(-1, dimension)
        self.len = np.frombuffer(self._bytes("len"), np.float64)

    def _bytes(self, name: str):
        return self._part.column(f"{self._side}_{name}")[self._row].as_buffer()

    @property
    def pos(self) -> np.ndarray:
        return np.frombuffer(self._bytes("pos"), np.int64)

    def list(self, name: str) -> pa.Array:
        return self._part.column(f"{self._side}_{name}")[self._row].values

    def units(self) -> np.ndarray:
        """Float vectors of length one or zero."""
        return (self.x * (1 / np.where(self.len == 0, 1.0, self.len))[:, None]).astype(np.float32)

    def cells(self, cell: int) -> np.ndarray:
        """The rows that have this cell."""
        width = -(-len(self.len) // 8)
        bits = np.frombuffer(self._bytes("cells"), np.uint8)[cell * width : (cell + 1) * width]
        return np.flatnonzero(np.unpackbits(bits)[: len(self.len)])


def margin(dimension: int) -> float:
    """More than float products of unit vectors can be wrong by."""
    return (dimension + 16) * 2.0**-24


def exact(a: Block, b: Block, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Float cosines of these pairs, the same values as ``vectors.cosine``: a running sum adds in index order."""
    out = np.zeros(len(rows), np.float32)
    for s in range(0, len(rows), EXACT):
        r, c = rows[s : s + EXACT], cols[s : s + EXACT]
        size = a.len[r] * b.len[c]
        dot = np.cumsum(a.x[r].astype(np.float64) * b.x[c], axis=1)[:, -1] if a.x.shape[1] else np.zeros(len(r))
        out[s : s + EXACT] = np.where(size == 0, 0.0, dot / np.where(size == 0, 1.0, size))
    return out


def _named(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns])


def meet(a: DataFrame, b: DataFrame, condition: Column | None, held: int, blocks: tuple[int, int]) -> DataFrame:
    """All pairs of kept blocks under a condition on ``a_`` and ``b_`` columns, in one narrow stage: a task streams a share of
    ``a`` and holds a share of ``b``. ``held``: bytes of ``b``; ``blocks``: how many there are on each side."""
    want = 4 * cores(a.sparkSession)
    split = max(min(blocks[1], max(math.isqrt(want) + 1, -(-held // SHARE), -(-want // max(1, blocks[0])))), 1)
    left = _named(a, "a").coalesce(max(1, min(blocks[0], -(-want // split))))
    right = _named(b, "b").coalesce(split).hint("shuffle_replicate_nl")
    return left.crossJoin(right) if condition is None else left.join(right, condition)


def meet_small(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of equal gid, for groups of few blocks: an ordinary join of the packed rows."""
    return _named(a, "a").join(_named(b, "b"), F.col("a_gid") == F.col("b_gid"))
