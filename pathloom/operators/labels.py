"""Checks of label sets and the evaluation of search and duplicate detection against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.vectors import score
from pathloom.operators import metrics
from pathloom.operators.knn import neighbours
from pathloom.scratch import keep


def label_problems(labels: dict[str, DataFrame], corpus: DataFrame) -> DataFrame:
    """(rule, detail): groups under two members, ids repeated in a group, ids in two duplicate groups, pairs of one id, unknown ids."""
    known = corpus.select("id")
    found = []
    for name in ("retrieval", "duplicates"):
        rows = labels[name]
        sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
        found.append(sizes.where("n < 2").select(F.lit(f"{name}: group under two members").alias("rule"), F.col("label").alias("detail")))
        found.append(sizes.where("d < n").select(F.lit(f"{name}: repeated id").alias("rule"), F.col("label").alias("detail")))
        found.append(rows.select("id").distinct().join(known, "id", "left_anti").select(F.lit(f"{name}: unknown id").alias("rule"), F.col("id").alias("detail")))
    twice = labels["duplicates"].groupBy("id").agg(F.count_distinct("label").alias("n")).where("n > 1")
    found.append(twice.select(F.lit("duplicates: id in two groups").alias("rule"), F.col("id").alias("detail")))
    pairs = labels["negatives"]
    found.append(pairs.where("leftId = rightId").select(F.lit("negatives: equal ids").alias("rule"), F.col("leftId").alias("detail")))
    ends = pairs.select(F.explode(F.array("leftId", "rightId")).alias("id")).distinct()
    found.append(ends.join(known, "id", "left_anti").select(F.lit("negatives: unknown id").alias("rule"), F.col("id").alias("detail")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def validate_labels(labels: dict[str, DataFrame], corpus: DataFrame) -> None:
    bad = label_problems(labels, corpus).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule} ({r.detail})" for r in bad))


def query_results(labels: dict[str, DataFrame], corpus: DataFrame, k: int = 5) -> DataFrame:
    """``retrieval`` with label, instruction and ``results``, the ranked (id, instruction, score) of each query."""
    rows = labels["retrieval"]
    asked = corpus.join(rows.select("id").distinct(), "id", "left_semi").select("id", "embedding", "platform", "app")
    ranked = keep(neighbours(asked, corpus.select("id", "embedding", "platform", "app"), k))
    texts = corpus.select("id", "instruction")
    found = ranked.join(texts, "id").select("qid", F.struct("rank", "id", "instruction", score(F.col("cos")).alias("score")).alias("r"))
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list("r")).alias("r"))  # k of a query at most
    lists = lists.select("qid", F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["instruction"].alias("instruction"), x["score"].alias("score"))).alias("results"))
    names = rows.groupBy(F.col("id").alias("qid")).agg(F.min_by("label", "ordinal").alias("label"))
    out = _measured(rows, ranked, k).join(names, "qid").join(texts.withColumnRenamed("id", "qid"), "qid").join(lists, "qid", "left")
    return out.withColumnRenamed("qid", "queryId").withColumn("results", F.coalesce("results", F.array().cast(lists.schema["results"].dataType)))


def retrieval(labels: dict[str, DataFrame], corpus: DataFrame, k: int = 5) -> DataFrame:
    """Metrics of each labelled row as a query among rows of its platform and app, with ``ordinal`` (place in the label set)."""
    rows = labels["retrieval"]
    asked = corpus.join(rows.select("id").distinct(), "id", "left_semi").select("id", "embedding", "platform", "app")
    ranked = neighbours(asked, corpus.select("id", "embedding", "platform", "app"), k)
    return _measured(rows, ranked, k)


def _measured(rows: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    other = rows.select("label", F.col("id").alias("other"))
    relevant = rows.join(other, "label").where("id <> other").select(F.col("id").alias("qid"), F.col("other").alias("id"))
    places = rows.groupBy(F.col("id").alias("qid")).agg(F.min("ordinal").alias("ordinal"))
    return metrics.retrieval_per_query(ranked, relevant, k).join(places, "qid")


def lowest_recall(per_query: DataFrame, n: int = 10) -> DataFrame:
    return per_query.orderBy("recall", "ordinal").limit(n)


def scored_pairs(labels: dict[str, DataFrame], corpus: DataFrame) -> DataFrame:
    return metrics.label_scored(labels["duplicates"], corpus, labels["negatives"])


def worst_errors(scored: DataFrame, threshold: float, n: int = 20) -> DataFrame:
    """Pairs on the wrong side of the threshold, most similar first."""
    wrong = F.col("duplicate") != (F.col("cos") >= F.lit(threshold).cast("float"))
    return scored.where(wrong).orderBy(F.desc("cos"), "left_id", "right_id").limit(n)


def evaluate(labels: dict[str, DataFrame], corpus: DataFrame, k: int = 5, threshold: float = 0.92) -> DataFrame:
    """One row: retrieval averages, the confusion at ``threshold``, and the best of the sweep."""
    validate_labels(labels, corpus)
    spark, sets = corpus.sparkSession, (labels["duplicates"], corpus)
    at = metrics.label_confusion(*sets, spark.createDataFrame([(float(threshold),)], "threshold float"), labels["negatives"])
    best = metrics.calibrated(metrics.label_confusion(*sets, metrics.sweep_thresholds(spark), labels["negatives"]))
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    parts = one(metrics.retrieval_summary(retrieval(labels, corpus, k)), "retrieval"), one(at, "deduplication"), one(best, "calibrated")
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def report(labels: dict[str, DataFrame], corpus: DataFrame, k: int = 5, threshold: float = 0.92) -> DataFrame:
    """``evaluate`` with the ten queries of lowest recall, the sweep of thresholds and the twenty worst pairs, as lists."""
    lowest = lowest_recall(query_results(labels, corpus, k))
    cols = ("recall", "ordinal", "queryId", "label", "instruction", "relevant", "hits", "precision", "first_rank", "rr", "results")
    scored = keep(scored_pairs(labels, corpus))
    sweep = metrics.confusion(scored, metrics.sweep_thresholds(corpus.sparkSession))
    left, right = (corpus.select(F.col("id").alias(f"{x}_id"), F.col("instruction").alias(f"{x}Instruction")) for x in ("left", "right"))
    wrong = worst_errors(scored, threshold).join(left, "left_id").join(right, "right_id")
    kind = F.when(F.col("duplicate"), "false-negative").otherwise("false-positive").alias("errorType")
    error = F.struct((-F.col("cos")).alias("order"), F.col("left_id").alias("leftId"), F.col("right_id").alias("rightId"), kind, "leftInstruction", "rightInstruction", F.col("cos").alias("similarity"))
    listed = lambda df, one, name: df.agg(F.array_sort(F.collect_list(one)).alias(name))
    out = evaluate(labels, corpus, k, threshold).crossJoin(listed(lowest, F.struct(*cols), "lowestRecallQueries"))  # one row each
    out = out.crossJoin(listed(sweep, F.struct("threshold", *[c for c in sweep.columns if c != "threshold"]), "thresholdSweep"))
    return out.crossJoin(listed(wrong, error, "errors").withColumn("errors", F.transform("errors", lambda e: e.dropFields("order"))))
