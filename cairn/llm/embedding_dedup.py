"""Operator 6: near-duplicate embeddings by random-hyperplane hashing, exact cosines and connected components.

Vectors that are equal after scaling to unit length, with the same label, are collapsed first and
keep their count. Each remaining vector gets `tables` codes of `bits` hyperplane signs; vectors with the same
label and code of a table meet. Cosines in double precision decide; a pair that met in an earlier table
is left to that table, so that links are counted once (the codes of a pair that reaches the threshold are worked out again where it meets).
Buckets give counts for each vector and a spanning set of links, never the pairs; a bucket over BUCKET rows is compared in blocks by several tasks.

Only the given components travel, in their own precision, once a table. Buckets hold some WANTED rows, as their products are one
multiplication of matrices: the more rows a bucket has, the fewer tables are needed. `bits` grows with the logarithm of the row count; `tables` follows
from it, for the asked recall of a pair that lies just at the threshold. Codes come from
seeded hyperplanes, so that results repeat.

Null, empty or zero vectors, ones with null or non-finite components, and null labels link with nothing
and are kept. Only vectors of one length are compared. Repeated rows and null ids keep a row each;
a null id never names a component. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.components import components
from cairn.llm.shared import Stage, shuffle_parts

#: Rows that a bucket should have, and rows that one task compares at once; larger buckets are dealt in blocks of it.
WANTED, BUCKET = 512, 4096
#: Rows of a block that are multiplied at once, and rows that a task gets, about.
STRIPE, TASK_ROWS = 512, 50_000
#: Large buckets are broadcast up to this count (under 1 MB), else joined by a shuffle.
LARGE_BUCKETS = 10_000


def plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits and tables: buckets of about WANTED rows were codes even, and the asked chance to meet at the threshold."""
    bits = min(60, max(4, math.ceil(math.log2(max(1, rows) / WANTED))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, count))


def scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, of finite rows that aren't zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def given(packed: list[bytes], wide: bool) -> np.ndarray:
    """Packed components as rows of doubles; all of one length."""
    kind = np.float64 if wide else np.float32
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)


def unit_rows(vectors: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, bool]:
    """(vec_id, label, unit, given): hash of the unit vector and the packed components, null where the row links with nothing; and whether components are doubles."""
    wide = "double" in vectors.schema[vector].dataType.simpleString()
    kind = np.float64 if wide else np.float32

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, names = [], []
            for v in batch.column(2):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                packed.append(None if x is None else x.tobytes())
                names.append(None if x is None else hashlib.blake2b(scaled(x[None].astype(np.float64)).tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "label", "unit", "given"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    usable = F.when(F.col(label).isNotNull(), F.col(vector))
    return vectors.select(F.col(vec_id), F.col(label), usable.alias("v")).mapInArrow(tk.frugal(f), f"vec_id {kinds[vec_id]}, label {kinds[label]}, unit binary, given binary"), wide


def codes_of(x: np.ndarray, bits: int, tables: int, seed: int, made: dict[int, np.ndarray]) -> np.ndarray:
    """The codes of unit vectors in all tables."""
    dim = x.shape[1]
    if dim not in made:
        made[dim] = planes(dim, bits * tables, seed)
    weights = 1 << np.arange(bits, dtype=np.int64)
    return ((x @ made[dim]) > 0).reshape(len(x), tables, bits) @ weights


def coded(points: DataFrame, bits: int, tables: int, seed: int, wide: bool) -> DataFrame:
    """(point, label, copies, given, way, code): a row for each point and table."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            packed = batch.column(3).to_pylist()
            sizes = np.array([len(p) for p in packed])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                codes = codes_of(scaled(given([packed[i] for i in rows], wide)), bits, tables, seed, made)
                part = batch.take(pa.array(rows))
                for way in range(tables):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), way, np.int32)), pa.array(codes[:, way])], names=["point", "label", "copies", "given", "way", "code"])

    kind = points.schema["label"].dataType.simpleString()
    return points.select("point", "label", "copies", "given").mapInArrow(tk.frugal(f), f"point long, label {kind}, copies long, given binary, way int, code long")


def compared(x: np.ndarray, y: np.ndarray | None, threshold: float, new) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of x, of y) that reach the threshold and didn't meet before, as `new` says of their vectors; y None: pairs inside x."""
    inside = y is None
    other = x if inside else y
    for lo in range(0, len(x), STRIPE):
        start = lo if inside else 0
        i, j = np.nonzero(x[lo : lo + STRIPE] @ other[start:].T >= threshold - 1e-9)
        i, j = i + lo, j + start
        if inside:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), 1 << 15):
            p, q = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            exact = np.einsum("ij,ij->i", x[p], other[q]) >= threshold
            p, q = p[exact], q[exact]
            if len(p):
                fresh = new(p, q)
                if fresh.any():
                    yield p[fresh], q[fresh]


class Spanning:
    """Union-find that keeps the links that join two parts."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        # pairs that already hang together are passed over in bulk
        while len(p):
            while (self.up != self.up[self.up]).any():
                self.up = self.up[self.up]
            apart = self.up[p] != self.up[q]
            p, q = p[apart], q[apart]
            for i, j in zip(p[:256].tolist(), q[:256].tolist(), strict=True):
                a, b = self.root(i), self.root(j)
                if a != b:
                    self.up[max(a, b)] = min(a, b)
                    self.links.append((i, j))
            p, q = p[256:], q[256:]


def bucket_links(rows: DataFrame, threshold: float, bits: int, tables: int, seed: int, wide: bool) -> DataFrame:
    """(point, links, other): partial link counts of a point (other null), or a link that spans (links 0)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            ids, copies, packed, side, way = zip(*held, strict=True)
            ids, copies, one, way = np.array(ids), np.array(copies), np.array(side) == 0, way[0]
            units = scaled(given(list(packed), wide))
            x, y = np.flatnonzero(one), np.flatnonzero(~one)
            whole = not len(y)
            known: dict[str, np.ndarray] = {}

            def new(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                if not way:
                    return np.ones(len(p), dtype=bool)
                if not known:  # codes are worked out only in buckets that hold a link
                    known["codes"] = codes_of(units, bits, tables, seed, made)[:, :way]
                c = known["codes"]
                return ~(c[x[p]] == c[(x if whole else y)[q]]).any(axis=1)

            counts, span = np.zeros(len(ids), dtype=np.int64), Spanning(len(ids))
            for p, q in compared(units[x], None if whole else units[y], threshold, new):
                p, q = x[p], (x if whole else y)[q]
                np.add.at(counts, p, copies[q])
                np.add.at(counts, q, copies[p])
                span.add(p, q)
            hit = np.flatnonzero(counts)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(counts[hit]), pa.nulls(len(hit), pa.int64())], names=["point", "links", "other"])
                a, b = np.array(span.links).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(np.zeros(len(a), np.int64)), pa.array(ids[b])], names=["point", "links", "other"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(6)]
            for k, *row in zip(*cols, strict=True):
                if k != key:
                    yield from flush()
                    key, held = k, []
                held.append(row)
        yield from flush()

    return rows.select("task", "point", "copies", "given", "side", "way").mapInArrow(tk.frugal(f), "point long, links long, other long")


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Adds task and side: a bucket is one task, a large one a task for each pair of its blocks."""
    key = ["way", "label", "code", "dim"]
    rows = rows.withColumn("dim", F.length("given"))
    large = Stage(rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > BUCKET)).df
    if large.count() <= LARGE_BUCKETS:
        large = F.broadcast(large)
    size = F.coalesce(F.col("size"), F.lit(1))
    rows = rows.join(large, key, "left").withColumn("blocks", F.ceil(size / BUCKET).cast("int")).withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    rows = rows.withColumn("pair", F.explode(every)).withColumn("side", F.when(F.col("block") == F.col("pair.lo"), 0).otherwise(1))
    rows = rows.withColumn("task", F.concat_ws("/", *(F.col(k).cast("string") for k in key), F.col("pair.lo"), F.col("pair.hi")))
    return rows.select("task", "point", "copies", "given", "side", "way").repartition(parts, "task").sortWithinPartitions("task")


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.93, recall: float = 0.995, seed: int = 7, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    parts = shuffle_parts(vectors.sparkSession)
    found, wide = unit_rows(vectors, vec_id, vector, label)
    rows = Stage(found.withColumn("point", F.when(F.col("unit").isNotNull(), F.xxhash64("label", "unit"))).drop("unit"))
    points = Stage(rows.df.where("point is not null").groupBy("point").agg(F.count("*").alias("copies"), F.min("label").alias("label"), F.min("given").alias("given")))
    size = points.df.count()
    bits, tables = plan(size, threshold, recall)
    parts = max(parts, -(-size * tables // TASK_ROWS))
    found = Stage(bucket_links(dealt(coded(points.df, bits, tables, seed, wide), parts), threshold, bits, tables, seed, wide))
    counts = found.df.where("other is null").groupBy("point").agg(F.sum("links").alias("links"))
    edges = found.df.where("other is not null").select("point", "other")
    labels = components(edges).select(F.col("node").alias("point"), F.col("label").alias("group"))
    known = points.df.select("point", "copies").join(counts, "point", "left").join(labels, "point", "left")
    known = known.select("point", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("group", "point").alias("group"))
    named = rows.df.select("vec_id", "point").join(known, "point", "left")
    least = named.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "group", "left")
    component = F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("least")).cast("long")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
edge AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach AS (WITH RECURSIVE r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.b FROM r JOIN edge e ON r.seen = e.a)
  SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS c FROM edge GROUP BY a)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN reach ON node = vec_id LEFT JOIN n ON a = vec_id
"""
