"""Readers: trajectory files, raw-row files and shards, label sets, failure pairs, vocabularies.

Schemas are explicit, so nothing is inferred and unused columns are pruned at the scan. Malformed JSON fails the read;
unknown keys are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.hashing import hash_embedding
from pathloom.schema import FAILURE_PAIRS, LABELS, ROWS_FILE, TRAJECTORY, normalise, validate
from pathloom.sources.parse import parse_rows

MAX_ROWS = 100_000
MAX_WORKERS = 16


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_trajectories(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A JSON array (or Parquet) of trajectories, with defaults filled in. No rows, or an invalid row, is an error."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else _json(spark, path, TRAJECTORY)
    df = normalise(raw)
    return validate(df) if check else df


def check_limit(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit must be 1 to {MAX_ROWS}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def first_rows(raw: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows of lowest ``row_idx``; fewer rows than that is an error."""
    check_limit(limit)
    some = raw.orderBy("row_idx").limit(limit)
    there = some.count()
    if there < limit:
        raise ValueError(f"{limit} rows wanted, {there} there")
    return some


def trajectories_of(raw: DataFrame, dim: int = 256) -> DataFrame:
    """Parsed rows with hash embeddings; a row without an instruction fails the query."""
    parsed = parse_rows(raw).withColumn("instruction", F.coalesce("instruction", F.raise_error(F.concat(F.lit("no instruction in "), F.col("id"))).cast("string")))
    vectors = hash_embedding(parsed, dim)
    return normalise(parsed.join(vectors, "id"))


def read_rows_file(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Raw rows ``(row_idx, messages, metadata, imageCount)`` of a saved page file ``{"rows": [...]}`` or an array of rows."""
    rows = spark.read.schema(T.StructType([T.StructField("rows", T.ArrayType(ROWS_FILE)), *ROWS_FILE.fields])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nested = rows.select(F.explode_outer("rows").alias("r"), "row_idx", "row").select(F.coalesce("r.row_idx", "row_idx").alias("row_idx"), F.coalesce("r.row", "row").alias("row"))
    images = F.coalesce(F.when(F.size("row.images") >= 0, F.size("row.images")), F.lit(0))
    return first_rows(nested.where("row is not null").select("row_idx", "row.messages", "row.metadata", images.alias("imageCount")), limit)


def list_shards(spark: SparkSession, folder: str, config: str | None = None, split: str | None = None) -> list[str]:
    """Parquet files below ``folder`` whose path has ``config`` and ``split`` as parts, by file name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        name = found.next().getPath().toString()
        parts = name.removesuffix(".parquet").replace("-", "/").split("/")
        if name.endswith(".parquet") and all(x is None or x in parts for x in (config, split)):
            out.append(name)
    return sorted(out, key=lambda x: (x.rpartition("/")[2], x))


def attempt(job: Callable, attempts: int = 3, wait: float = 2.0):
    """The result of ``job``, tried again after ``wait`` seconds, then twice ``wait`` and so on."""
    for n in range(1, attempts + 1):
        try:
            return job()
        except Exception as e:
            if n == attempts:
                raise RuntimeError(f"failed in {attempts} attempts") from e
            time.sleep(wait * n)
    raise ValueError("no attempts")


def read_shards(spark: SparkSession, files: list[str], limit: int | None = None, workers: int = 4) -> DataFrame:
    """Raw rows of Parquet shards in order of ``files``, ``row_idx`` counted across them.

    Row numbers come from each file's own row index plus the rows of the files before it (from the footers), so nothing
    is sorted. ``workers`` files are counted at once, each in up to three attempts; files beyond ``limit`` are never opened for data."""
    if not files:
        raise ValueError("no shards")
    if not 1 <= workers <= MAX_WORKERS:
        raise ValueError(f"workers must be 1 to {MAX_WORKERS}")
    base, used, total = [], [], 0
    with ThreadPoolExecutor(workers) as pool:
        for a in range(0, len(files), workers):
            if limit is not None and total >= limit:
                break
            wave = files[a : a + workers]
            for name, n in zip(wave, pool.map(lambda name: attempt(spark.read.parquet(name).count), wave), strict=True):
                if limit is None or total < limit:
                    base.append((name, total))
                    used.append(name)
                    total += n
    if limit is not None and total < limit:
        raise ValueError(f"{limit} rows wanted, {total} there")
    tail = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    starts = spark.createDataFrame(base, "file string, before long").select(tail(F.col("file")).alias("file"), "before")
    rows = spark.read.parquet(*used).select("messages", "metadata", tail(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("at"))
    out = rows.join(F.broadcast(starts), "file").select((F.col("before") + F.col("at")).alias("row_idx"), "messages", "metadata")  # a row for each listed file
    return out if limit is None else out.where(F.col("row_idx") < limit)


def read_labels(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables of a label set: retrieval and duplicates (label, ordinal, id), negatives (leftId, rightId)."""
    one = _json(spark, path, LABELS)

    def members(column: str) -> DataFrame:
        rows = one.select(F.posexplode(column).alias("g", "group")).select("g", "group.label", F.posexplode("group.memberIds").alias("m", "id"))
        return rows.select("label", (F.col("g").cast("long") * 1_000_000 + F.col("m")).alias("ordinal"), "id")

    return {"retrieval": members("retrievalGroups"), "duplicates": members("duplicateGroups"), "negatives": one.select(F.explode("negativePairs").alias("p")).select("p.leftId", "p.rightId")}


def read_failure_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, FAILURE_PAIRS).select(F.explode("pairs").alias("p")).select("p.*")


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token to id (line number); of repeated tokens the last counts. A vocabulary file is one small file."""
    text = spark.read.text(path, wholetext=True).limit(1).first()
    return {token: i for i, token in enumerate((text[0] if text else "").split("\n")) if token or i == 0}


def in_order(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """``df`` with ``ordinal``, its place by ``order`` (small tables: one task)."""
    return df.withColumn("ordinal", F.row_number().over(Window.orderBy(order)) - 1)
