"""Corpus pipeline: toxic documents go, then documents outside the quality rules, then all but one of each group of
near-duplicates; secrets are masked and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. Documents with a null doc_id are judged like others; rows that share a doc_id
stay if one of them does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.near_duplicates import near_duplicates
from tessella.llm.ngram_perplexity import score_quality
from tessella.llm.packing import pack
from tessella.llm.secret_scan import redact_secrets
from tessella.llm.toxicity import drop_toxic

#: Least similarity of near-duplicates in the corpus, in percent.
NEAR = 80


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    ids = verdicts.where("kept").select(F.col("doc_id").alias("_kept_id"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(common.table_path(sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, score_quality(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, near_duplicates(docs, percent=NEAR))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("near dedup", near_dedup), ("secret scans", secret_scans), ("packing", packing)]

ORACLE_SQL = None  # models and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(common.table_path(sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
