"""Session helpers used by several operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one in local mode, which has one machine; else it refuses."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Shuffle files go when a stage's query ends, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Python workers get at once: texts and packed sets are long, and both sides hold a batch several times.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of this session get at most 1000 rows at once."""
    key, most = ARROW_ROWS
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


class Stage:
    """A table written to the shared folder, so that what follows neither recomputes nor drags its lineage. It goes with `drop`, or when the application ends."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{work_dir(self.spark)}/cairn/{uuid.uuid4().hex}"
        self.schema = df.schema
        small_batches(self.spark)
        before = self.spark.conf.get(CLEANED)
        self.spark.conf.set(CLEANED, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(CLEANED, before)
        path, files = self._file()
        files.deleteOnExit(path)

    def _file(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path, files = self._file()
        files.delete(path, True)


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A table of a few rows. It comes as Arrow data: from lists of rows executors would start Python workers of another kind, and keep them."""
    return spark.createDataFrame(pa.table(columns))


def cut(df: DataFrame) -> DataFrame:
    return Stage(df).df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(keys: DataFrame) -> DataFrame:
    """A written table of keys: broadcast up to BROADCAST_KEYS rows, else joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def without(df: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """Rows of `df` that match none of `gone`; `same` compares columns of both, whose names differ."""
    return df.join(bounded(cut(gone.distinct())), same, "left_anti")
