"""Exchange with a benchmark tool: shards, queries and neighbours out, results in; and the receipt of a query subset."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labels of a case that ended well, failed, or ran out of time; figures of a case that are taken over.
NORMAL, FAILED, LATE = ":)", "x", "?"
FIGURES = ("qps", "serial_latency_p50", "serial_latency_p95", "serial_latency_p99", "recall", "ndcg", "load_duration", "insert_duration", "optimize_duration", "max_load_count")


def train_shards(df: DataFrame, id_: str, shards: int) -> DataFrame:
    """Adds the name of the shard a row is exported to: even ranges by id, nulls last, the first ones a row longer.

    Only the ids at which shards begin are sought: ids are counted by ranges, and ranges with a begin are ranked, so that no task ranks all ids.
    Each job draws the bounds of ranges anew, so a range is kept as its least and greatest id, never as its number.
    Rows of one id that a begin parts go by their other columns, as JSON; one task numbers them.
    """
    parts = max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(F.col(id_).alias("__id")).agg(F.count("*").alias("__n"))
    ranged = counts.repartitionByRange(parts, F.col("__id").asc_nulls_last()).withColumn("__part", F.spark_partition_id())
    known = F.sum(F.when(F.col("__id").isNotNull(), F.col("__n")).otherwise(0))
    ranges = ranged.groupBy("__part").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi"), F.sum("__n").alias("n"), known.alias("known")).collect()  # a row for each range
    total = sum(r["n"] for r in ranges)
    whole, more = divmod(total, shards)
    begins = [b for s in range(1, shards) if (b := s * whole + min(s, more)) < total]
    before, held = 0, []
    for r in sorted(ranges, key=lambda r: r["__part"]):
        if any(before <= b < before + r["known"] for b in begins):
            held.append((r["lo"], r["hi"], before))
        before += r["known"]
    firsts = [(None, b - before) for b in begins if b >= before]  # (id, rows of that id that belong to shards before)
    if held:
        inside = counts.withColumn("__before", F.coalesce(*(F.when(F.col("__id").between(lo, hi), F.lit(n).cast("long")) for lo, hi, n in held))).where("__before is not null")
        start = F.col("__before") + F.sum("__n").over(Window.partitionBy("__before").orderBy("__id")) - F.col("__n")
        met = F.filter(F.array(*(F.lit(b).cast("long") for b in begins)), lambda b: (b >= F.col("__start")) & (b < F.col("__start") + F.col("__n")))
        found = inside.withColumn("__start", start).select("__id", "__start", F.explode(met).alias("__begin")).collect()  # a row for each begin
        firsts += [(r["__id"], r["__begin"] - r["__start"]) for r in found]
    parted = F.lit(False)
    for x in {x for x, ties in firsts if ties}:
        parted = parted | F.col(id_).eqNullSafe(F.lit(x))
    placed = df.withColumn("__tie", F.lit(0))
    if any(ties for _, ties in firsts):
        tie = F.row_number().over(Window.partitionBy(id_).orderBy(F.to_json(F.struct(*df.columns)))) - 1
        placed = placed.where(~parted).unionByName(df.where(parted).withColumn("__tie", tie))
    shard = F.lit(0)
    for x, ties in firsts:
        later = F.lit(False) if x is None else F.coalesce(F.col(id_) > F.lit(x), F.lit(True))
        shard = shard + (later | (F.col(id_).eqNullSafe(F.lit(x)) & (F.col("__tie") >= ties))).cast("int")
    return placed.withColumn("shard", F.format_string(f"train-%02d-of-{shards:02d}", shard)).drop("__tie")


def export(base: DataFrame, queries: DataFrame, truth: DataFrame, path: str, *, shards: int, k: int) -> None:
    """Writes train (id, emb) in ranges by id, test (id, emb) and neighbors (id, neighbors_id): bit for bit the given floats. Nothing is overwritten."""
    vectors = lambda df, id_: df.select(F.col(id_).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("emb"))
    vectors(base, "vec_id").repartitionByRange(shards, "id").sortWithinPartitions("id").write.parquet(f"{path}/train")
    vectors(queries, "query_id").write.parquet(f"{path}/test")
    near = truth.where(F.col("rank") <= k).groupBy(F.col("query_id").cast("long").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("n"))
    near.select("id", F.transform("n", lambda x: x["vec_id"].cast("long")).alias("neighbors_id")).write.parquet(f"{path}/neighbors")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of result files: (run_id, engine, engine_version, label, outcome, reason, figures...). A case that didn't end well couldn't be checked and has no figures."""
    figures = ", ".join(f"{f}: double" for f in FIGURES)
    case = f"struct<label: string, task_config: struct<db: string, db_config: struct<version: string>>, metrics: struct<{figures}>>"
    df = spark.read.schema(f"run_id string, results array<{case}>").option("multiLine", "true").json(path)
    return imported(df.select("run_id", F.explode(F.when(F.col("results").isNull(), F.raise_error(F.lit("a file has no results"))).otherwise(F.col("results"))).alias("c")))


def imported(df: DataFrame) -> DataFrame:
    """The rows of (run_id, c), c a case."""
    fine = F.col("c.label") == NORMAL
    why = F.when(F.col("c.label") == LATE, "a stage ran out of time").when(F.col("c.label") == FAILED, "the case failed").otherwise("an unknown label")
    taken = [F.when(F.coalesce(fine, F.lit(False)), F.col(f"c.metrics.{f}")).alias(f) for f in FIGURES]
    return df.select(
        "run_id", F.col("c.task_config.db").alias("engine"), F.col("c.task_config.db_config.version").alias("engine_version"), F.col("c.label").alias("label"),
        F.when(fine, "measured").otherwise("couldnt_check").alias("outcome"), F.when(~F.coalesce(fine, F.lit(False)), why).alias("reason"), *taken,
    )


def seeded(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"))


def query_subset(queries: DataFrame, id_: str, size: int, seed: int) -> DataFrame:
    """`size` of the ids, by md5(seed:id); more than there are, or none, is refused."""
    if size <= 0:
        raise ValueError("a subset has at least one query")
    if size > (n := queries.count()):
        raise ValueError(f"{size} of {n} queries")
    return queries.select(id_).orderBy(seeded(F.col(id_), seed), id_).limit(size)


def write_subset(subset: DataFrame, id_: str, path: str, seed: int) -> str:
    """Writes a subset's receipt once, and returns its SHA-256; a file that is there stays as it is and raises."""
    ids = sorted(r[0] for r in subset.select(id_).collect())  # a stated query set
    text = json.dumps({"ids": ids, "seed": seed, "size": len(ids)}, sort_keys=True, indent=2) + "\n"
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)
    return hashlib.sha256(text.encode()).hexdigest()


def published_points(pages: DataFrame, pattern: str = r"M=(\d+), efConstruction=(\d+)[^0-9]+ef=(\d+)[^0-9]+recall=([0-9.]+)") -> DataFrame:
    """(m, ef_construction, recall): distinct recalls of a page's (html) points, read by a pattern of four groups."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("p"))
    part = lambda i: F.regexp_extract("p", pattern, i)
    return found.select(part(1).cast("int").alias("m"), part(2).cast("int").alias("ef_construction"), F.round(part(4).cast("double"), 6).alias("recall")).distinct()


def complete_sweeps(points: DataFrame, grid: list[int]) -> DataFrame:
    """(m, ef_construction, ef, recall) of those that have as many distinct recalls as the grid has values: the i-th smallest belongs to the i-th. Others stay out, nothing is interpolated."""
    lists = points.groupBy("m", "ef_construction").agg(F.sort_array(F.collect_set("recall")).alias("r")).where(F.size("r") == len(grid))
    rows = lists.select("m", "ef_construction", F.posexplode(F.arrays_zip(F.array(*map(F.lit, sorted(grid))).alias("ef"), F.col("r").alias("recall"))).alias("i", "x"))
    return rows.select("m", "ef_construction", "x.ef", "x.recall")
