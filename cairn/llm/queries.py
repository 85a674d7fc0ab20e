"""The opN queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, embedding_dedup, language_id, lm_score, mixture, secret_scan, shingle_join, toxicity, url_filter
from cairn.llm.shared import table
from cairn.llm.token_count import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE_SQL["op10_decontamination"] = decontaminate.ORACLE


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), [url_filter.Rule.read(x) for x in url_filter.RULES])


ORACLE_SQL["op7_url_filter"] = url_filter.ORACLE


@query
def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents")).drop("class")


ORACLE_SQL["op5_shingle_join"] = shingle_join.ORACLE


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op6_embedding_dedup"] = embedding_dedup.ORACLE


def remainder(doc_id: str, of: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of, F.lit(-1))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.scored(docs, toxicity.train(docs, labels.where(remainder("doc_id", 5) != 0)))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", remainder("doc_id", 7) != 2)
    out = lm_score.scores(docs)
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.probabilities(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 9) for c in ("weight", "probability")})


ORACLE_SQL["op1_mixture"] = mixture.oracle()


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(table(spark, sf_dir, "documents"))
    return language_id.identify_pages(table(spark, sf_dir, "pages"), model)


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train())
