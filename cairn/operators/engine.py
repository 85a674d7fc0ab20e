"""A vector engine inside the session: named tables of vectors with exact search. Written rows replace those of the same id."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import knn
from cairn.operators.vectors import l2, inner, normalized

#: Metrics and the sign that makes a larger score the better one.
METRICS = ("inner_product", "cosine", "l2")


@dataclass
class Engine:
    """Namespaces live in a folder that driver and executors share; each write makes a new version and the old one goes."""

    spark: SparkSession
    folder: str
    prefix: str = "cairn_"
    spaces: dict[str, dict] = field(default_factory=dict)

    def create(self, name: str, dim: int, metric: str = "inner_product") -> None:
        if metric not in METRICS:
            raise ValueError(f"no metric {metric}; there are {METRICS}")
        if not re.fullmatch(re.escape(self.prefix) + r"[a-z0-9_]+", name):
            raise ValueError(f"a namespace begins with {self.prefix}")
        if name in self.spaces:
            raise ValueError(f"{name} exists")
        self.spaces[name] = {"dim": dim, "metric": metric, "version": 0, "writes": 0}

    def need(self, name: str) -> dict:
        if name not in self.spaces:
            raise KeyError(f"no namespace {name}")
        return self.spaces[name]

    def path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/v{version}"

    def rows(self, name: str) -> DataFrame:
        space = self.need(name)
        return self.spark.read.parquet(self.path(name, space["version"])) if space["version"] else self.spark.createDataFrame([], "vec_id long, e array<double>")

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Rows (vec_id, e), the last of an id by `at` where there is one; another length than the namespace's is refused. Returns how many were written."""
        space = self.need(name)
        if rows.where(F.size("e") != space["dim"]).limit(1).count():
            raise ValueError(f"vectors of {space['dim']} components are wanted")
        order = F.struct("at", "e") if "at" in rows.columns else F.struct("e")
        new = rows.groupBy("vec_id").agg(F.max(order)["e"].alias("e"))
        kept = self.rows(name).join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)
        kept.write.parquet(self.path(name, space["version"] + 1))
        if space["version"]:
            self._remove(self.path(name, space["version"]))
        space["version"] += 1
        space["writes"] += 1
        return new.count()

    def search(self, name: str, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score, rank), exact; the score of `l2` is the distance with its sign turned."""
        metric = self.need(name)["metric"]
        base = self.rows(name)
        if metric == "cosine":
            base, queries = (df.withColumn("e", normalized(F.col("e"))) for df in (base, queries))
        return knn.exact(base, queries, k, metric="l2" if metric == "l2" else "ip")

    def scroll(self, name: str, limit: int) -> DataFrame:
        return self.rows(name).orderBy("vec_id").limit(limit)

    def describe(self, name: str) -> dict:
        space = self.need(name)
        return {"name": name, "vectors": self.rows(name).count(), "index": "flat", **{k: space[k] for k in ("dim", "metric", "writes")}}

    def exists(self, name: str) -> bool:
        return name in self.spaces

    def delete(self, name: str) -> None:
        if self.spaces.pop(name, None):
            self._remove(f"{self.folder}/{name}")

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def pairwise(pairs: DataFrame, metric: str) -> DataFrame:
    """Adds score to pairs of vectors (a, b) by a metric, larger being nearer."""
    score = {"inner_product": inner(F.col("a"), F.col("b")), "cosine": inner(normalized(F.col("a")), normalized(F.col("b"))), "l2": -l2(F.col("a"), F.col("b"))}
    return pairs.withColumn("score", F.round(score[metric], 9))
