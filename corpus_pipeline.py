"""A training corpus from `documents`: five stages, each over all that the one before kept.

1. language: documents whose language isn't identified go;
2. near_duplicates: of each group of linked rows the one with the smallest id stays, once; an id says nothing about other rows that have it;
3. decontamination: documents that hold a benchmark window go;
4. secrets: confirmed secrets are masked in the text, which keeps its document;
5. mixture: documents are sampled by raked weights.

Stages 1 and 4 use trained models, so that SQL can't express the whole: ORACLE_SQL is None, and the tests hold run() against
a plain version over small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, language_id, mixture, secret_scan, shingle_join
from cairn.llm.shared import cut, table, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash"))
    return without(docs, gone, docs["doc_id"].eqNullSafe(F.col("gone")) & (F.xxhash64(docs["text"]) == F.col("gone_hash")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs, secret_scan.train())


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
