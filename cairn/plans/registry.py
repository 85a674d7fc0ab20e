"""Where queries and their SQL are put down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that must agree."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Literal:
    """A small table given by its rows, for Spark and for SQL alike. Types by their DuckDB names."""

    SPARK = {"VARCHAR": "string", "DOUBLE": "double", "BIGINT": "bigint", "BOOLEAN": "boolean", "INT": "int"}

    def __init__(self, name: str, columns: str, rows: list[tuple]):
        self.name, self.rows = name, rows
        self.columns = [tuple(c.split()) for c in columns.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, ", ".join(f"`{c}` {self.SPARK[t]}" for c, t in self.columns))

    def sql(self) -> str:
        """A named table of a WITH clause."""
        value = lambda v, t: f"CAST({'NULL' if v is None else repr(v) if isinstance(v, (int, float)) else chr(39) + v + chr(39)} AS {t})"
        selects = [", ".join(f'{value(v, t)} AS "{c}"' for v, (c, t) in zip(row, self.columns, strict=True)) for row in self.rows]
        return f"{self.name} AS (" + " UNION ALL ".join(f"SELECT {x}" for x in selects) + ")"
