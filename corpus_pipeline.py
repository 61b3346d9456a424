"""From raw documents to a mixed training corpus, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet to the folder that the cluster shares
and read again as the next one's input. The stages decide: documents of no language, all but one of each group of near
copies and documents with benchmark passages go, personal data becomes pseudonyms, and what is left is mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import decontaminate, langid, mixing, pii, simhash
from pathloom.llm.common import keep, table
from pathloom.llm.queries import QUERY_KEY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or null), and those far from every language learned, go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes pseudonyms, under the session's key or else the one of the registered queries."""
    return pii.rewrite(docs, spark.conf.get(pii.KEY_CONF, None) or QUERY_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each stretch of a document in an output slot."""
    return mixing.mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("mix", mix)]
#: The classifiers, fingerprints and permutations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
