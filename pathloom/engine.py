"""The engine: a corpus with a search strategy behind one interface, and the registry of strategies."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.operators import ann, dedup, knn
from pathloom.schema import normalise, validate
from pathloom.scratch import keep

MAX_BATCH = 10_000


class Engine:
    """Exact search. ``rebuild`` first; a search before that is an error.

    ``folder`` keeps the corpus as Parquet partitioned by the filter keys, so that filters prune folders; each rebuild
    writes a folder of its own and readers of the former one are not disturbed."""

    name = "exact"

    def __init__(self, folder: str | None = None):
        self.folder, self.corpus, self.dimension, self.builds = folder, None, 0, 0

    def rebuild(self, trajectories: DataFrame) -> Engine:
        df = validate(normalise(trajectories))
        self.builds += 1
        if not self.folder:
            return self._opened(keep(df))
        path = f"{self.folder.rstrip('/')}/build-{self._last(df.sparkSession) + 1:06d}"
        df.write.mode("errorifexists").partitionBy("platform", "app", "success").parquet(path)
        return self._opened(df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns))

    def open(self, spark: SparkSession) -> Engine:
        """The last finished build in ``folder``, as another engine left it."""
        last = self._last(spark)
        if not last:
            raise FileNotFoundError(f"no build in {self.folder}")
        return self._opened(normalise(spark.read.parquet(f"{self.folder.rstrip('/')}/build-{last:06d}")))

    def _last(self, spark: SparkSession) -> int:
        """The number of the last build whose writer finished; 0 for none."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/build-*/_SUCCESS")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return max((int(f.getPath().getParent().getName().removeprefix("build-")) for f in found), default=0)

    def _opened(self, corpus: DataFrame) -> Engine:
        began = time.time()
        self.corpus = corpus
        self.dimension = corpus.agg(F.max(F.size("embedding"))).first()[0]
        self.seconds = time.time() - began
        return self

    def health(self) -> dict:
        """Whether a search would run, and over what."""
        return {"status": "ok" if self.corpus is not None else "empty", "strategy": self.name, "dimension": self.dimension, "folder": self.folder}

    def filter_counts(self) -> DataFrame:
        """(platform, app, success, n): rows behind each combination of filters."""
        return self._ready().groupBy("platform", "app", "success").agg(F.count("*").alias("n"))

    def _ready(self) -> DataFrame:
        if self.corpus is None:
            raise RuntimeError("nothing was built yet")
        return self.corpus

    def search(self, embedding: Sequence[float], k: int = 5, platform: str | None = None, app: str | None = None, success: bool | None = None) -> DataFrame:
        corpus = self._ready()
        return self._nearest(corpus, knn.check_vector(embedding, self.dimension), knn.check_k(k), platform, app, success)

    def _nearest(self, corpus: DataFrame, vector: list[float], k: int, platform, app, success) -> DataFrame:
        return knn.search(corpus, vector, k, platform, app, success)

    def search_by_id(self, trajectory_id: str, k: int = 5, success: bool | None = None) -> DataFrame:
        """Neighbours of a stored row within its platform and app, without itself."""
        corpus = self._ready()
        row = corpus.where(F.col("id") == trajectory_id).select("embedding", "platform", "app").first()
        if row is None:
            raise KeyError(trajectory_id)
        found = self.search(row.embedding, min(knn.MAX_K, knn.check_k(k) + 1), row.platform, row.app, success)
        rank = F.row_number().over(Window.orderBy("rank"))
        return found.where(F.col("id") != trajectory_id).withColumn("rank", rank).where(F.col("rank") <= k)

    def search_batch(self, queries: DataFrame) -> DataFrame:
        """``queries(qid, embedding, k, platform, app, success)``, at most ``MAX_BATCH`` of them."""
        if queries.limit(MAX_BATCH + 1).count() > MAX_BATCH:
            raise ValueError(f"over {MAX_BATCH} queries")
        return knn.search_batch(queries, self._ready())

    def find_duplicate_groups(self, threshold: float = 0.985, candidates: int = 10) -> DataFrame:
        return dedup.duplicate_groups(self._ready(), threshold, candidates)

    def stats(self) -> DataFrame:
        """One row: count, dimension, strategy."""
        return self._ready().agg(F.count("*").alias("count"), F.lit(self.dimension).alias("dimension"), F.lit(self.name).alias("strategy"))


class ApproximateEngine(Engine):
    """An inverted file of cells; exact where the filters leave under ``ann.EXACT_BELOW`` rows, and for batches and groups."""

    name = "ivf"

    def __init__(self, folder: str | None = None, cells: int | None = None, probes: float = ann.PROBES):
        super().__init__(folder)
        self.cells, self.probes, self.model = cells, probes, None

    def _opened(self, corpus: DataFrame) -> Engine:
        super()._opened(corpus)
        self.model = ann.build(corpus, self.cells)
        return self

    def _nearest(self, corpus: DataFrame, vector: list[float], k: int, platform, app, success) -> DataFrame:
        some = knn.matching(corpus, platform, app, success)
        if some.limit(ann.EXACT_BELOW).count() < ann.EXACT_BELOW:
            return super()._nearest(some, vector, k, None, None, None)
        query = corpus.sparkSession.createDataFrame([("query", vector)], "qid string, embedding array<float>")
        near = ann.approximate_neighbours(self.model, query, some.select("id", "embedding"), k, self.probes)
        rows = some.drop("embedding").join(near.select("id", "cos", "rank"), "id")
        return rows.withColumn("score", knn.score(F.col("cos")))


STRATEGIES = {"exact": Engine, "ivf": ApproximateEngine, "approximate": ApproximateEngine}


def create(name: str | None = None, **options) -> Engine:
    """A strategy by name; none given: exact; an unknown name is an error."""
    key = (name or "exact").strip().lower()
    if key not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[key](**options)
