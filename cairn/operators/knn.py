"""Exact nearest neighbours, searches over subsets, merges of shards, and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.vectors import inner, scored_top

#: Candidates (of all queries) that are broadcast to the vectors when they are scored again; more are joined by a shuffle.
BROADCAST_CANDIDATES = 500_000


def ranked(found: DataFrame, k: int, by: str = "query_id", id_: str = "vec_id") -> DataFrame:
    """The k best rows of each query with their rank from 1; ties by the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), id_)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(base: DataFrame, queries: DataFrame, k: int, *, vector: str = "e", metric: str = "ip") -> DataFrame:
    """(query_id, vec_id, score, rank): every query against all rows, in blocks of queries.

    Each task keeps k rows a query, so that what is shuffled grows with queries and tasks, not with rows.
    """
    return ranked(scored_top(base, queries, k, metric=metric, vector=vector), k).select("query_id", "vec_id", "score", "rank")


def merged(candidates: DataFrame, k: int) -> DataFrame:
    """Merges answers of shards (query_id, shard, vec_id, score): the first of a vector by score and shard stays, then the k best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "shard", "vec_id")
    return deduped(candidates).where("survived").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def deduped(candidates: DataFrame) -> DataFrame:
    """Adds survived: the first of a query's vector by score, then shard."""
    first = Window.partitionBy("query_id", "vec_id").orderBy(F.desc("score"), "shard")
    return candidates.withColumn("survived", F.row_number().over(first) == 1)


def shard_answers(placed: DataFrame, queries: DataFrame, depth: int, *, shard: str, routes: DataFrame | None = None) -> DataFrame:
    """(query_id, shard, vec_id, score): the `depth` best rows of each asked shard. `routes` (query_id, region): the shards a query asks, else all.

    Vectors carry their shard, so nothing but answers is shuffled. Routes are those of a stated query set.
    """
    asked = None
    if routes is not None:
        asked = {r.region: r.q for r in routes.groupBy("region").agg(F.collect_list("query_id").alias("q")).collect()}
    found = scored_top(placed, queries, depth, group=shard, routes=asked)
    of = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("i", F.row_number().over(of)).where(F.col("i") <= depth).select("query_id", F.col("group").alias("shard"), "vec_id", "score")


def kept_truth(base: DataFrame, queries: DataFrame, k: int, path: str) -> DataFrame:
    """Exact neighbours, kept in a table for further runs: used again where it holds min(k, rows) neighbours for as many queries, else made anew beside it."""
    spark = base.sparkSession
    asked, rows = queries.count(), base.limit(k).count()
    folder = f"{path}/q{asked}-k{k}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) or spark.read.parquet(folder).count() != asked * rows:
        exact(base, queries, k).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def rescored(retrieved: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, vec_id, rank) scored by their vectors again, stable on the old rank; what wasn't retrieved stays absent."""
    wanted = retrieved.select("query_id", "vec_id", F.col("rank").alias("before")).join(F.broadcast(queries.select("query_id", F.col("e").alias("q"))), "query_id")
    few = wanted.count() <= BROADCAST_CANDIDATES
    both = base.select("vec_id", "e").join(F.broadcast(wanted) if few else wanted, "vec_id")
    again = both.withColumn("score", F.round(inner(F.col("q"), F.col("e")), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return again.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")
