"""Regions of a corpus: centroids, distances, closure, routing, and hash shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.vectors import collected, matrix

MAX_ASSIGN = 4
#: Centroids are a stated parameter and live on the driver and in every task.
MAX_CENTROIDS = 65_536


def partial_sums(points: DataFrame, home, *, vector: str) -> DataFrame:
    """(region, i, x, n): sums of components and rows of each region in each task. `home` gives the region of each row of a batch (extra columns, vectors)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            of = home(batch, x)
            for r in np.unique(of).tolist():
                part = x[of == r]
                sums[r] = sums.get(r, 0) + part.sum(0)
                rows[r] = rows.get(r, 0) + len(part)
        for r, total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(total), pa.array(np.full(n, rows[r], np.int64))], names=["region", "i", "x", "n"])

    return points.mapInArrow(f, "region long, i int, x double, n long")


def means(sums: DataFrame, digits: int) -> DataFrame:
    parts = sums.groupBy("region", "i").agg(F.round(F.sum("x") / F.sum("n"), digits).alias("x"), F.sum("n").alias("size"))
    order = F.sort_array(F.collect_list(F.struct("i", "x")))  # as long as a vector
    return parts.groupBy("region").agg(F.transform(order, lambda s: s["x"]).alias("centroid"), F.max("size").alias("size"))


def centroids(df: DataFrame, region: str, vector: str = "e", digits: int = 9) -> DataFrame:
    """(region, centroid, size): component means, from one pass of partial sums."""
    rows = df.where(F.col(region).isNotNull()).select(vector, F.col(region).cast("long"))
    return means(partial_sums(rows, lambda batch, x: batch.column(1).to_numpy(), vector=vector), digits)


def to_centroids(x: np.ndarray, table: np.ndarray, digits: int) -> np.ndarray:
    return np.round(np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (table**2).sum(1)[None, :] - 2 * x @ table.T)), digits)


def near(points: DataFrame, cents: DataFrame, t: int, *, id_: str = "vec_id", vector: str = "e", carry: bool = False, digits: int = 9) -> DataFrame:
    """(id, near, vector if carried): the t nearest centroids by Euclidean distance as an array of (region, d), ties by region. One row stays one row."""
    keys, table = collected(cents, "region", "centroid", MAX_CENTROIDS)
    sent = points.sparkSession.sparkContext.broadcast((np.array(keys, dtype=np.int64), table))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = sent.value
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            d = to_centroids(x, table, digits)
            order = np.argsort(d, axis=1, kind="stable")[:, :t]
            n, width = order.shape
            cells = pa.StructArray.from_arrays([pa.array(keys[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], ["region", "d"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *([batch.column(1)] if carry else [])], names=[id_, "near", *([vector] if carry else [])])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    more = f", {vector} {kinds[vector]}" if carry else ""
    return points.select(id_, vector).mapInArrow(f, f"{id_} {kinds[id_]}, near array<struct<region: bigint, d: double>>{more}")


def distances(points: DataFrame, cents: DataFrame, t: int, *, id_: str = "vec_id", vector: str = "e", digits: int = 9) -> DataFrame:
    """(id, slot, region, d): the same as rows, slot 0 the nearest."""
    found = near(points, cents, t, id_=id_, vector=vector, digits=digits)
    return found.select(id_, F.posexplode("near").alias("slot", "x")).select(id_, "slot", "x.region", "x.d")


def placed(points: DataFrame, cents: DataFrame, eps: float, *, most: int = MAX_ASSIGN, id_: str = "vec_id", vector: str = "e") -> DataFrame:
    """(id, slot, region, d, vector): the closure's copies with their vectors, made row by row."""
    found = near(points, cents, most, id_=id_, vector=vector, carry=True)
    copies = F.filter(F.transform("near", lambda x, i: F.struct(i.alias("slot"), x["region"].alias("region"), x["d"].alias("d"))), lambda c: (c["slot"] == 0) | (c["d"] <= F.get("near", F.lit(0))["d"] * (1 + eps)))
    return found.select(id_, F.explode(copies).alias("c"), vector).select(id_, "c.slot", "c.region", "c.d", vector)


def lloyd(df: DataFrame, k: int, rounds: int, seed: int, *, id_: str = "vec_id", vector: str = "e", digits: int = 9) -> DataFrame:
    """(region, centroid, size): deterministic k-means. Seeds are the first k rows by md5(seed:id); an empty region keeps its centroid.

    A round is one pass that assigns rows and sums them by region; k x dim numbers come back."""
    start = df.select(id_, vector).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")).cast("binary")), id_).limit(k).collect()
    if len(start) < k:
        raise ValueError(f"{k} centroids need as many rows")
    spark = df.sparkSession
    now, size = np.array([[float(x) for x in r[1]] for r in start]), np.zeros(k, dtype=np.int64)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(now)
        home = lambda batch, x, sent=sent: to_centroids(x, sent.value, digits).argmin(1)
        size = np.zeros(k, dtype=np.int64)
        now = now.copy()
        for r in means(partial_sums(df.select(vector), home, vector=vector), digits).collect():
            now[r.region], size[r.region] = r.centroid, r["size"]
        sent.unpersist()
    return spark.createDataFrame([(i, [float(x) for x in c], int(n)) for i, (c, n) in enumerate(zip(now, size, strict=True))], "region long, centroid array<double>, size long")


def closure(dist: DataFrame, eps: float, most: int = MAX_ASSIGN) -> DataFrame:
    """(id..., slot, region, d): copies of a vector in regions within (1 + eps) of its nearest; slot 0 always."""
    by = [c for c in dist.columns if c not in ("slot", "region", "d")]
    home = F.min(F.when(F.col("slot") == 0, F.col("d"))).over(Window.partitionBy(*by))
    return dist.where(F.col("slot") < most).withColumn("home", home).where((F.col("slot") == 0) | (F.col("d") <= F.col("home") * (1 + eps))).drop("home")


def route(dist: DataFrame, probe: int) -> DataFrame:
    return dist.where(F.col("slot") < probe)


def hash_shard(id_: Column, shards: int, seed: int = 0) -> Column:
    """Shard by the first 8 hexadecimal digits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
