"""``python -m pathloom <command>``: import, embed, report, evaluate, inject-failures, evaluate-recovery, benchmark, search, serve."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pathloom import engine, serve, sinks
from pathloom.functions.hashing import with_hash_embedding
from pathloom.functions.wordpiece import OnnxModel, WordPiece, embed_with
from pathloom.operators import dedup, inject, knn, labels, metrics, recovery, report, sampling
from pathloom.scratch import keep
from pathloom.sources import readers
from pathloom.sources.parse import embedding_text
from pathloom.streaming.imports import import_rows


#: Single queries of a benchmark.
SINGLES = 20


def _import(spark, a):
    if a.rows_file:
        raw = readers.read_rows_file(spark, a.rows_file, a.limit)
    elif a.shards:
        raw = readers.read_shards(spark, readers.list_shards(spark, a.shards, a.config, a.split), a.limit, a.workers)
    else:
        raw = import_rows(spark, f"{a.output}.rows", f"{a.output}.partial", url=a.url, dataset=a.dataset or "", config=a.config or "", split=a.split or "", offset=a.offset, limit=a.limit)
    df = readers.trajectories_of(raw, a.dimension)
    sinks.write_trajectories(df, a.output)
    return sinks.import_summary(df).withColumn("bytes", F.lit(sinks.stored_bytes(spark, a.output)))


def _embed(spark, a):
    df = readers.read_trajectories(spark, a.data, check=False)
    if a.model:
        model = OnnxModel(a.model, WordPiece(readers.read_vocabulary(spark, a.vocabulary), a.max_length))
        df = embed_with(df.withColumn("_text", embedding_text(F.col("instruction"), F.col("app"), F.col("actions"))), "_text", model, a.batch).drop("_text")
    else:
        df = with_hash_embedding(df, a.dimension)
    sinks.write_trajectories(df, a.output)
    return sinks.import_summary(df)


def _report(spark, a):
    df = readers.read_trajectories(spark, a.data)
    groups = keep(dedup.duplicate_groups(df, a.threshold, a.candidates))
    stats = dedup.group_stats(groups.select(F.col("canonical_id").alias("root"), F.explode("member_ids")))
    return report.dataset_report(df).crossJoin(stats).crossJoin(dedup.first_groups(groups))  # one row each


def _evaluate(spark, a):
    return labels.report(readers.read_labels(spark, a.labels), readers.read_trajectories(spark, a.data), a.k, a.threshold)


def _inject(spark, a):
    df = readers.read_trajectories(spark, a.data)
    chosen = readers.read_labels(spark, a.labels)["retrieval"] if a.labels else None
    both, pairs = inject.inject(df, a.count, chosen)
    sinks.write_trajectories(both, a.output)
    out = sinks.pair_set(pairs, "controlled failures", "1", "truncated to two thirds of the actions")
    out.write.mode("overwrite").json(a.pairs)
    return pairs


def _recovery(spark, a):
    df, pairs = readers.read_trajectories(spark, a.data), readers.read_failure_pairs(spark, a.pairs)
    bad = recovery.problems(df, pairs).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.failureId}" for r in bad))
    return recovery.recovery_summary(recovery.recovery_per_failure(df, pairs, a.k), a.k)


def _benchmark(spark, a):
    """Both strategies: a batch and ``SINGLES`` single queries, timed after untimed runs of the same shape, and the accuracy of the approximate one."""
    if not 1 <= a.queries <= 10_000:
        raise ValueError("queries must be 1 to 10000")
    df = readers.read_trajectories(spark, a.data)
    exact, approximate = engine.create("exact").rebuild(df), engine.create("ivf").rebuild(df)
    asked = sampling.seeded_sample(exact.corpus.select("id", "embedding"), a.queries).withColumnRenamed("id", "qid")
    truth = knn.knn_join(asked, exact.corpus.select("id", "embedding"), (), a.k)
    found = engine.ann.approximate_neighbours(approximate.model, asked, None, a.k)

    def timed(job) -> float:
        began = time.time()
        job()
        return time.time() - began

    out = metrics.ann_accuracy(truth, found)
    for name, batch, one in (("exact", truth, exact), ("approximate", found, approximate)):
        seconds = [timed(lambda b=batch: b.write.mode("overwrite").format("noop").save()) for _ in range(2)][1]
        vectors = [r.embedding for r in asked.limit(SINGLES).collect()]
        each = sorted([timed(lambda v=v, e=one: e.search(v, a.k).collect()) for v in [vectors[0], *vectors]][1:])
        rank = lambda share, x=each: round(1000 * x[max(0, -(-int(100 * share) * len(x) // 100) - 1)], 3)
        out = out.withColumns({f"{name}_seconds": F.lit(round(seconds, 3)), f"{name}_queries_per_second": F.lit(round(a.queries / seconds, 1)), f"{name}_p50_ms": F.lit(rank(0.5)), f"{name}_p95_ms": F.lit(rank(0.95))})
    return out


def _search(spark, a):
    return engine.create(a.strategy).rebuild(readers.read_trajectories(spark, a.data)).search_by_id(a.id, a.k)


def _serve(spark, a):
    """Until interrupted."""
    built = engine.create(a.strategy).rebuild(readers.read_trajectories(spark, a.data))
    http = serve.server(serve.Service(spark, built), a.port)
    print(f"port {http.server_port}", flush=True)
    try:
        http.serve_forever()
    except KeyboardInterrupt:
        pass
    return built.stats()


COMMANDS = {"import": _import, "embed": _embed, "report": _report, "evaluate": _evaluate, "inject-failures": _inject, "evaluate-recovery": _recovery, "benchmark": _benchmark, "search": _search, "serve": _serve}
OPTIONS = {
    "data": str, "output": str, "labels": str, "pairs": str, "rows-file": str, "shards": str, "url": str, "dataset": str, "config": str, "split": str, "model": str, "vocabulary": str, "strategy": str, "id": str,
    "offset": (int, 0), "limit": (int, 500), "dimension": (int, 256), "batch": (int, 16), "max-length": (int, 256), "k": (int, 5), "count": (int, 57), "queries": (int, 500), "candidates": (int, 10), "workers": (int, 4), "port": (int, 8080), "threshold": (float, 0.92),
}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    for name, kind in OPTIONS.items():
        parser.add_argument(f"--{name}", type=kind if isinstance(kind, type) else kind[0], default=None if isinstance(kind, type) else kind[1])
    parser.add_argument("--report", help="folder for the result as JSON")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("pathloom").getOrCreate()
    out = COMMANDS[a.command](spark, a)
    if a.report:
        sinks.write_report(out, a.report)
    out.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
