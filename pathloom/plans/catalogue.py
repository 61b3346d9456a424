"""The registered queries: each applies an operator to whole tables. Their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.hashing import hash_embedding, hash_features, with_hash_embedding
from pathloom.functions.vectors import score
from pathloom.operators import ann, dedup, inject, knn, metrics, recovery, report, sampling
from pathloom.plans import oracle
from pathloom.plans.views import conv, doc, messages, read, vec
from pathloom.schema import violations
from pathloom.scratch import keep
from pathloom.sources.parse import embedding_text, image_count

Query = Callable[[SparkSession, str], DataFrame]
LOW, DOC_T = 0.35, 0.92


def _first(df: DataFrame, where: str = "true"):
    """The stored row with the smallest id: the example query."""
    return df.where(where).agg(F.min_by(F.struct("id", "embedding"), "id").alias("r")).first().r


def _number():
    """The number in an id, of any length."""
    return F.substring("id", 5, 30).cast("long")


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in names else c for c in df.columns])


def _ranked(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(*ids, F.round(F.col("cos").cast("double"), 6).alias("cos"), F.col("rank").cast("long").alias("rank"))


def q01_search_topk(spark, sf_dir):
    v = vec(spark, sf_dir)
    found = knn.search(v, _first(v).embedding, 5)
    return found.select("id", F.round(F.col("cos").cast("double"), 6).alias("cos"), F.round(score(F.col("cos")).cast("double"), 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def q02_search_filtered(spark, sf_dir):
    v = vec(spark, sf_dir)
    return _ranked(knn.search(v, _first(v).embedding, 10, " ", "app-1", True), "id")


def q03_search_by_id(spark, sf_dir):
    return _ranked(knn.search_by_id(vec(spark, sf_dir), "vec-000007", 5), "id")


def q04_search_batch(spark, sf_dir):
    v = vec(spark, sf_dir)
    n = _number()
    asked = v.where(n % 10 == 0).select(F.col("id").alias("qid"), "embedding", (n % 7 + 1).cast("int").alias("k"), F.when(n % 20 == 0, F.col("platform")).alias("platform"), F.when(n % 30 == 0, F.lit("")).otherwise(F.col("app")).alias("app"), F.when(n % 40 == 0, F.lit(True)).alias("success"))
    return _ranked(knn.search_batch(asked, v), "qid", "id")


def q05_knn_unfiltered(spark, sf_dir):
    v = vec(spark, sf_dir)
    return _ranked(knn.knn_join(v.select(F.col("id").alias("qid"), "embedding"), v.select("id", "embedding"), (), 10), "qid", "id")


def _labelled(spark, sf_dir):
    """V1 with the intent as its only filter key, where near pairs exist."""
    return vec(spark, sf_dir).select("id", "embedding", "intent")


def q06_dedup_edges(spark, sf_dir):
    return _six(dedup.duplicate_edges(_labelled(spark, sf_dir), LOW, 10, ("intent",)), "cos")


def q07_dedup_groups(spark, sf_dir):
    found = dedup.duplicate_groups(_labelled(spark, sf_dir), LOW, 10, ("intent",))
    return found.select("canonical_id", F.array_join("member_ids", ",").alias("member_ids"), F.round(F.col("mean_cos").cast("double"), 4).alias("mean_cos"))


def q08_hash_features(spark, sf_dir):
    return hash_features(doc(spark, sf_dir), 256)


def q09_hash_embedding(spark, sf_dir):
    found = hash_embedding(doc(spark, sf_dir), 256).select("id", F.posexplode("embedding").alias("bucket", "value"))
    return found.where("value <> 0").select("id", "bucket", F.round(F.col("value").cast("double"), 5).alias("value"))


def _hashed(spark, sf_dir):
    d = doc(spark, sf_dir)
    return keep(with_hash_embedding(d, 256).select("id", "platform", "app", "success", "source", "embedding"))


def q10_doc_dedup(spark, sf_dir):
    return dedup.duplicate_members(_hashed(spark, sf_dir), DOC_T, 10)


def q11_doc_group_stats(spark, sf_dir):
    return dedup.group_stats(dedup.duplicate_members(_hashed(spark, sf_dir), DOC_T, 10))


def q12_conv_parse(spark, sf_dir):
    return conv(spark, sf_dir).select("id", "instruction", "app", "success", F.array_join("actions", " | ").alias("actions"), F.size("actions").cast("long").alias("n"))


def q13_embed_text(spark, sf_dir):
    return conv(spark, sf_dir).select("id", embedding_text(F.col("instruction"), F.col("app"), F.col("actions")).alias("text"))


def q14_counts(spark, sf_dir):
    return report.counts_by(doc(spark, sf_dir), "app", "source", "success")


def _retrieval(spark, sf_dir):
    v = vec(spark, sf_dir)
    ranked = knn.neighbours(v.select("id", "embedding", "platform", "app"), v.select("id", "embedding", "platform", "app"), 5)
    return metrics.retrieval_by_label(ranked, v.select(F.col("intent").alias("label"), "id"), 5)


def q15_retrieval_per_query(spark, sf_dir):
    return _six(_retrieval(spark, sf_dir), "recall", "precision", "rr")


def q16_retrieval_summary(spark, sf_dir):
    return _six(metrics.retrieval_summary(_retrieval(spark, sf_dir)), "recall", "precision", "hit_rate", "mrr")


def _groups(spark, sf_dir):
    """A label set: every row under its intent, in order of id."""
    return vec(spark, sf_dir).select(F.col("intent").alias("label"), F.col("id").alias("ordinal"), "id")


def q17_label_pairs(spark, sf_dir):
    return _six(metrics.label_scored(_groups(spark, sf_dir), vec(spark, sf_dir)), "cos")


def _confusion(spark, sf_dir, thresholds):
    return metrics.label_confusion(_groups(spark, sf_dir), vec(spark, sf_dir), thresholds)


def _at(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values], "threshold float")


_METRICS = ("threshold", "precision", "recall", "f1")


def q18_confusion(spark, sf_dir):
    return _six(_confusion(spark, sf_dir, _at(spark, 0.2)), *_METRICS)


def q19_sweep(spark, sf_dir):
    return _six(_confusion(spark, sf_dir, metrics.sweep_thresholds(spark, 1, 40)), *_METRICS)


def q20_calibrated(spark, sf_dir):
    return _six(metrics.calibrated(_confusion(spark, sf_dir, metrics.sweep_thresholds(spark, 1, 40))), *_METRICS)


def q21_inject(spark, sf_dir):
    both, _ = inject.inject(conv(spark, sf_dir), 10)
    return both.select("id", "success", F.array_join("actions", " | ").alias("actions"), "source", "sourceId", "imageCount")


def _recovery(spark, sf_dir):
    both, pairs = inject.inject(conv(spark, sf_dir), 10)
    both = keep(with_hash_embedding(both, 64))
    same = both.where("success").select("app", F.col("id").alias("other"))
    lists = both.where("not success").select("app", F.col("sourceId").alias("successfulId")).join(same, "app").where("other <> successfulId").groupBy("successfulId").agg(F.sort_array(F.collect_set("other")).alias("alternativeSuccessfulIds"))
    return recovery.recovery_per_failure(both, keep(pairs.drop("alternativeSuccessfulIds").join(lists, "successfulId", "left")), 5)


def q22_recovery_per_failure(spark, sf_dir):
    return _six(_recovery(spark, sf_dir), "recall", "precision", "rr")


def q23_recovery_summary(spark, sf_dir):
    names = ("parent_recall_1", "parent_recall_k", "recall", "hit_rate", "mrr")
    return _six(recovery.recovery_summary(_recovery(spark, sf_dir), 5), *names)


def q24_percentiles(spark, sf_dir):
    return metrics.nearest_rank(read(spark, sf_dir, "documents"), "n_chars", (0.5, 0.95, 0.99))


def q25_lowest_recall(spark, sf_dir):
    return _six(_retrieval(spark, sf_dir).orderBy("recall", "qid").limit(10).select("qid", "recall", "hits"), "recall")


def q26_sample_even(spark, sf_dir):
    return sampling.even_sample(vec(spark, sf_dir).select("id"), 57)


def q27_validate(spark, sf_dir):
    v = vec(spark, sf_dir)
    n = _number()
    spoilt = v.select(
        F.when(n % 50 == 1, F.lit("vec-000000")).otherwise(F.col("id")).alias("id"), F.when(n % 40 == 2, F.lit(" ")).otherwise(F.lit("x")).alias("instruction"), "platform", "app", "success", F.array().cast("array<string>").alias("actions"),
        F.when(n % 60 == 3, F.transform("embedding", lambda x: F.lit(0).cast("float"))).when(n % 70 == 4, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"), F.when(n % 90 == 5, F.lit(-1)).otherwise(F.lit(0)).alias("imageCount"),
    )
    return violations(spoilt, 64).groupBy("rule").agg(F.count("*").alias("n"))


def q28_lsh_recall(spark, sf_dir):
    v = vec(spark, sf_dir).select("id", "embedding")
    asked = v.withColumnRenamed("id", "qid")
    truth, found = knn.knn_join(asked, v, (), 10), ann.approximate_neighbours(ann.build(v), asked, None, 10)
    return metrics.ann_accuracy(keep(truth), keep(found))


def q29_image_count(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", image_count(F.col("m")).cast("long").alias("images"))


def q30_report(spark, sf_dir):
    v = vec(spark, sf_dir).withColumn("imageCount", (_number() % 4).cast("int")).withColumn("source", F.lit("local"))
    return report.dataset_report(v)


def q31_doc_search(spark, sf_dir):
    d = _hashed(spark, sf_dir)
    return _ranked(knn.neighbours(d.where(_number() % 100 == 0).select("id", "embedding", "platform", "app"), d.select("id", "embedding", "platform", "app"), 5), "qid", "id")


def queries() -> dict[str, Query]:
    return {name: f for name, f in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
