"""Recall and its parts, latencies and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(predicted: DataFrame, truth: DataFrame, k: int, name: str = "recall") -> DataFrame:
    """One row: found true neighbours over true neighbours, both of rank up to k; missing answers are misses."""
    want = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    have = predicted.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit")).distinct()
    return want.join(have, ["query_id", "vec_id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias(name))


def recalls(predicted: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row with recall_at_k for each k, from one join."""
    have = predicted.select("query_id", "vec_id", F.col("rank").alias("__p")).dropDuplicates(["query_id", "vec_id"])
    both = truth.join(have, ["query_id", "vec_id"], "left")
    share = lambda k: F.sum(((F.col("rank") <= k) & (F.coalesce("__p", F.lit(k + 1)) <= k)).cast("long")) / F.sum((F.col("rank") <= k).cast("long"))
    return both.agg(*(share(k).alias(f"recall_at_{k}") for k in ks))


def present(candidates: DataFrame, truth: DataFrame, k: int, name: str = "present") -> DataFrame:
    """Share of the true k that lie anywhere among the candidates."""
    return recall(candidates.select("query_id", "vec_id", F.lit(0).alias("rank")), truth, k, name)


def decomposition(reach: DataFrame, candidates: DataFrame, first_pass: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """What the first retrieval lost, in three parts that sum to 1 - its recall: out of the routes' reach, reached but not among the
    candidates, among them but ranked beyond k, which is all that reranking can recover."""
    out = present(reach, truth, k, "ceiling").join(present(candidates, truth, k, "candidate_recall")).join(recall(first_pass, truth, k, "recall_before_rerank"))
    return out.select(
        "ceiling", "candidate_recall", "recall_before_rerank", (1 - F.col("ceiling")).alias("routing_loss"), (F.col("ceiling") - F.col("candidate_recall")).alias("candidate_loss"),
        (F.col("candidate_recall") - F.col("recall_before_rerank")).alias("ordering_loss"),
    )


def metric_agreement(exact: DataFrame, published: DataFrame, k: int) -> DataFrame:
    """Mean share of published neighbours (query_id, vec_id, rank) that exact search finds among its first k too."""
    return recall(exact, published, k, "agreement")


def embedding_cost(rates: DataFrame, records: int) -> DataFrame:
    """(model, probed, seconds) of probes to the rate and the hours that `records` would take; a probe without time can't be checked."""
    rate = F.try_divide(F.col("probed").cast("double"), F.col("seconds"))
    return rates.select("model", rate.alias("per_second"), (F.lit(records) / rate / 3600).alias("hours"), F.when(rate.isNull(), "couldnt_check").otherwise("projected").alias("outcome"))


def inverse_ratio(predicted: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean over all queries of true over returned distance at rank k, at most 1; fewer than k answers give 0."""
    away = lambda s: F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * s))
    t = truth.where(F.col("rank") == k).select("query_id", away(F.col("score")).alias("t"))
    p = predicted.where(F.col("rank") == k).select("query_id", away(F.col("score")).alias("p"))
    ratio = F.when(F.col("p").isNull(), 0.0).when(F.col("p") == 0, F.when(F.col("t") == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.col("t") / F.col("p")))
    return t.join(p, "query_id", "left").agg(F.avg(ratio).alias("inv_ratio"))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def spread(df: DataFrame, value: str) -> DataFrame:
    """Of one figure over runs."""
    return df.agg(F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("middle"), F.max(value).alias("most"), (F.max(value) - F.min(value)).alias("spread"), F.count(value).alias("runs"))


def load_summary(df: DataFrame, by: list[str], seconds: Column, error: Column, target: float) -> DataFrame:
    """Reached rate, error share, and whether the rate fell short of nine tenths of the target."""
    rate = F.count("*") / seconds
    return df.groupBy(*by).agg(rate.alias("achieved_qps"), F.avg(error.cast("double")).alias("error_rate"), (rate < 0.9 * target).alias("shortfall"))


def round_trip_noise(df: DataFrame, fastest: dict[str, str], most: float = 0.2) -> DataFrame:
    """(…, engine, transport, rtt_p95, query_p95) to share and outcome: usable, environment_noise, or unanswerable_here where the fastest
    transport of that engine was used already, so that another run can't help."""
    best = F.create_map(*[F.lit(x) for kv in fastest.items() for x in kv]) if fastest else F.create_map().cast("map<string,string>")
    share = F.when(F.col("query_p95") > 0, F.col("rtt_p95") / F.col("query_p95"))
    used = F.coalesce(F.col("transport") == F.try_element_at(best, F.col("engine")), F.lit(False))
    out = F.when(share.isNull() | (share <= most), "usable").when(used, "unanswerable_here").otherwise("environment_noise")
    return df.withColumn("rtt_share", share).withColumn("outcome", out)


def ladder(df: DataFrame, errors: float = 0.005, slower: float = 5.0) -> DataFrame:
    """Rungs (rung, qps, error_rate, p99) in order: the best rate before the first that degrades, and that rung."""
    order = Window.orderBy("rung")
    first = F.first("p99").over(order)
    bad = (F.col("error_rate") > errors) | (F.col("p99") > slower * first)
    gone = F.max(bad.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("gone", gone)
    return marked.agg(F.max(F.when(F.col("gone") == 0, F.col("qps"))).alias("ceiling_qps"), F.min(F.when(F.col("gone") == 1, F.col("rung"))).alias("degraded_at"))


def fan_out(df: DataFrame) -> DataFrame:
    """Nodes (node, qps, p95): figures over nodes; fewer than two can't be checked."""
    return df.agg(
        F.avg("qps").alias("mean_qps"), F.min("qps").alias("min_qps"), F.avg("p95").alias("mean_p95"), F.max("p95").alias("max_p95"), F.min_by("node", "qps").alias("slowest_by_qps"), F.max_by("node", "p95").alias("slowest_by_p95"),
        F.when(F.count("*") < 2, "couldnt_check").otherwise("measured").alias("outcome"),
    )


def reachability(truth: DataFrame, n_base: int) -> DataFrame:
    return truth.agg(F.avg((F.col("vec_id") < n_base).cast("double")).alias("reachable"))


def tie_bound(truth: DataFrame, k: int, within: float = 1e-6) -> DataFrame:
    """Share of queries whose k-th and next score are equal within a tolerance."""
    a = truth.where(F.col("rank") == k).select("query_id", F.col("score").alias("a"))
    b = truth.where(F.col("rank") == k + 1).select("query_id", F.col("score").alias("b"))
    return a.join(b, "query_id", "left").agg(F.avg(F.coalesce((F.abs(F.col("a") - F.col("b")) <= within).cast("double"), F.lit(0.0))).alias("tied"))


def distance_recall(predicted: DataFrame, truth: DataFrame, k: int, eps: float = 1e-6) -> DataFrame:
    """Share of returned scores that reach the k-th true score, within eps; missing answers are misses."""
    edge = truth.where(F.col("rank") == k).select("query_id", F.col("score").alias("edge"))
    hit = predicted.where(F.col("rank") <= k).join(edge, "query_id", "right")
    return hit.groupBy("query_id").agg((F.sum((F.col("score") >= F.col("edge") - eps).cast("int")) / k).alias("r")).agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("distance_recall"))
