"""Vector columns: usable rows, unit length, products and distances, and blocked kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has finite components only, at least one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, not squared."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def normalized(vector: Column) -> Column:
    """Unit length in double precision; a zero vector stays zero."""
    size = F.sqrt(inner(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def collected(df: DataFrame, key: str, vector: str, most: int) -> tuple[list, np.ndarray]:
    """Keys and vectors of a small table, in order of the key; refuses more than `most` rows."""
    rows = df.select(key, vector).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows for the driver")
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


#: Bytes of query vectors that are broadcast at once; more queries are searched in blocks, each by a scan of its own.
QUERY_BYTES = 128 << 20
#: Queries that are multiplied at once.
STRIPE = 256


def query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and vectors of a stated query set, a block of at most some QUERY_BYTES at a time."""
    n = queries.count()
    if not n:
        return
    dim = len(queries.select(vector).first()[0])
    blocks = -(-n * dim * 8 // QUERY_BYTES)
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        rows = part.select(key, vector).orderBy(key).collect()  # about QUERY_BYTES, as hashes deal evenly
        if rows:
            yield np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)


def best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of each slot, ties by the smaller id; sorted by slot."""
    order = np.lexsort((ids, -score, slot))
    slot = slot[order]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
    return order[rank < k]


def scored_top(base: DataFrame, queries: DataFrame, k: int, *, metric: str = "ip", group: str | None = None, routes: dict[int, list[int]] | None = None, id_: str = "vec_id", vector: str = "e", digits: int = 9) -> DataFrame:
    """(query_id, group, id, score): for each query and group, the k best rows of every part of `base`; not yet merged over parts.

    Without a group column there is the group 0. `routes`: the ids of the queries that ask a group, by group; None: all ask all. A task keeps k rows for
    each query and group it has met. Scores are rounded to `digits`, so that ties don't hang on the order of additions.
    """
    spark = base.sparkSession
    rows = base.select(id_, vector, (F.lit(0) if group is None else F.col(group)).cast("long").alias("__group"))
    kind = base.schema[id_].dataType.simpleString()
    out = None
    for keys, points in query_blocks(queries, "query_id", "e" if "e" in queries.columns else vector):
        place = {int(q): i for i, q in enumerate(keys)}
        asks = None if routes is None else {g: np.array(sorted(place[q] for q in qs if q in place), dtype=np.int64) for g, qs in routes.items()}
        sent = spark.sparkContext.broadcast((keys, points, asks))

        def f(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, points, asks = sent.value
            everyone = np.arange(len(keys))
            q0, g0, s0, i0 = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))
            for batch in batches:
                ids, x, groups = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
                found = [(q0, g0, s0, i0)]
                for g in np.unique(groups).tolist():
                    here = np.flatnonzero(groups == g) if group is not None else np.arange(len(ids))
                    asking = everyone if asks is None else asks.get(g, everyone[:0])
                    y, y_ids = x[here], ids[here]
                    square = (y * y).sum(1) if metric != "ip" else None
                    for lo in range(0, len(asking), STRIPE):
                        some = asking[lo : lo + STRIPE]
                        scores = points[some] @ y.T
                        if metric != "ip":
                            scores = -np.sqrt(np.maximum(0, (points[some] ** 2).sum(1)[:, None] + square[None, :] - 2 * scores))
                        scores = np.round(scores, digits)
                        if len(y_ids) > 4 * k:  # the k-th best of each query bounds what can stay
                            r, c = np.nonzero(scores >= np.partition(scores, len(y_ids) - k, axis=1)[:, len(y_ids) - k, None])
                        else:
                            r, c = np.divmod(np.arange(scores.size), len(y_ids))
                        found.append((some[r], np.full(len(r), g), scores[r, c], y_ids[c]))
                q0, g0, s0, i0 = map(np.concatenate, zip(*found, strict=True))
                _, slot = np.unique(np.stack([q0, g0], 1), axis=0, return_inverse=True) if len(q0) else (None, q0)
                at = best(slot.ravel(), s0, i0, k)
                q0, g0, s0, i0 = q0[at], g0[at], s0[at], i0[at]
            if len(q0):
                yield pa.RecordBatch.from_arrays([pa.array(keys[q0]), pa.array(g0), pa.array(i0), pa.array(s0)], names=["query_id", "group", id_, "score"])

        part = rows.mapInArrow(f, f"query_id long, group long, {id_} {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"query_id long, group long, {id_} {kind}, score double") if out is None else out
