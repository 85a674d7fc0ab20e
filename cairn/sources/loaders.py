"""Readers and writers: vectors, ids, texts, queries, NumPy files, digests, shards for a benchmark tool, cleaned texts."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vectors(spark: SparkSession, path: str, id_: str | None = None) -> DataFrame:
    """(vec_id, embedding) from Parquet with one list column, or a column for each dimension, or from .npy files."""
    if path.endswith(".npy"):
        return npy(spark, path)
    df = spark.read.parquet(path)
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    if len(lists) > 1:
        raise ValueError(f"several list columns: {lists}")
    rest = [f.name for f in df.schema if f.name != id_]
    vector = F.col(lists[0]) if lists else F.array(*(F.col(c).cast("float") for c in rest))
    key = F.col(id_) if id_ else F.monotonically_increasing_id()
    return df.select(key.alias("vec_id"), vector.cast("array<float>").alias("embedding"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of two-dimensional arrays; an id is the row's place in its file."""

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                x = np.load(io.BytesIO(content))
                if x.ndim != 2 or not len(x):
                    raise ValueError("an array of two dimensions with rows is wanted")
                for lo in range(0, len(x), 4096):
                    yield pd.DataFrame({"vec_id": np.arange(lo, min(lo + 4096, len(x))), "embedding": list(x[lo : lo + 4096].astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(f, "vec_id long, embedding array<float>")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) from JSON lines; a line without text is an error, ids are strings."""
    df = spark.read.schema("id string, text string").option("mode", "FAILFAST").json(path)
    return df.select("id", F.when(F.col("text").isNull(), F.raise_error(F.lit("a line has no text"))).otherwise(F.col("text")).alias("text"))


def ids(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """(pos, id) from a JSON list or from lines of text, ids as strings in their order; another count than `expected` is an error."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("x"))
        out = whole.select(F.posexplode("x").alias("pos", "id"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "").alias("x"))
        out = whole.select(F.posexplode("x").alias("pos", "id"))
    if (n := out.count()) != expected:
        raise ValueError(f"{n} ids for {expected} rows")
    return out


def metadata(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """A Parquet table beside the vectors; another row count than `expected` is an error."""
    df = spark.read.parquet(path)
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows of metadata for {expected} vectors")
    return df


def projection(spark: SparkSession, path: str, expected: int, id_: str = "vec_id") -> DataFrame:
    """(id, x, y): a declared placement for drawing only. Every vector has one, and all are finite."""
    df = spark.read.parquet(path).select(id_, F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    n, odd = df.agg(F.count("*"), F.sum((bad("x") | bad("y")).cast("long"))).first()
    if n != expected or odd:
        raise ValueError(f"{n} places for {expected} vectors, {odd or 0} of them not finite")
    return df


def records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of all Parquet shards under a folder, only the asked columns read; a missing one is named."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {gone}")
    return df.select(*columns)


def categorized(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, abstract, categories, primary, year) from JSON lines {id, title, abstract, categories, update_date}."""
    df = spark.read.schema("id string, title string, abstract string, categories string, update_date string").json(path)
    return df.select("id", "title", "abstract", "categories", primary_category(F.col("categories")).alias("primary"), year_of(F.col("update_date")).alias("year"))


def year_of(date: Column) -> Column:
    """The first four characters as a number, null where they are none."""
    return F.substring(date.cast("string"), 1, 4).try_cast("int")


def primary_category(categories: Column) -> Column:
    return F.get(F.split(F.trim(categories), r"\s+"), F.lit(0))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, embedding or text) from Parquet or JSON lines {id, vector | text}."""
    if path.endswith(".parquet"):
        return vectors(spark, path).withColumnRenamed("vec_id", "query_id")
    df = spark.read.schema("id string, vector array<float>, text string").json(path)
    return df.select(F.col("id").alias("query_id"), F.col("vector").alias("embedding"), "text")


FORMATS = {"vectors": vectors, "npy": npy, "texts": texts, "queries": queries, "categorized": categorized}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"no format {kind}; there are {sorted(FORMATS)}")
    return FORMATS[kind](spark, path)


def renamed(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Columns by their roles (role to column)."""
    if gone := [c for c in roles.values() if c not in df.columns]:
        raise ValueError(f"no columns {gone}")
    return df.withColumnsRenamed({c: r for r, c in roles.items()})


def digest(df: DataFrame, line: Column) -> DataFrame:
    """One SHA-256 over the sorted digests of lines, counts included; two levels, so that no task holds all lines."""
    each = df.select(F.sha2(line, 256).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    group = each.withColumn("g", F.substring("d", 1, 2)).groupBy("g").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "d", "n"))), "\n"), 256).alias("h"))
    return group.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda s: F.concat_ws(":", s["g"], s["h"])), "\n"), 256).alias("digest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def manifest(digests: DataFrame) -> DataFrame:
    """(line): `sha256  name` of each file, by name."""
    return digests.select(F.concat_ws("  ", "sha256", "name").alias("line"), "name").orderBy("name").select("line")


def manifest_digest(digests: DataFrame) -> DataFrame:
    """One SHA-256 over the lines of a manifest; it names few files."""
    return digests.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("  ", "sha256", "name"))), "\n"), 256).alias("digest"))


def pinned(digests: DataFrame, pins: DataFrame) -> DataFrame:
    """Digests against pinned ones (name, sha256): verified, contradicted, absent, unpinned."""
    both = digests.select("name", F.col("sha256").alias("x")).join(pins.withColumnRenamed("sha256", "y"), "name", "full")
    return both.select("name", F.when(F.col("y").isNull(), "unpinned").when(F.col("x").isNull(), "absent").when(F.col("x") == F.col("y"), "verified").otherwise("contradicted").alias("outcome"))


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def clean_markup(text: Column) -> Column:
    """One line of prose. Five rules in order: fenced code goes, indented code goes, links become their words, tags go,
    backticks go and white space becomes single spaces. Null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"(?m)^(?: {4}|\t).*$", " ")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.replace(out, F.lit("`"), F.lit("")), r"(?U)\s+", " "))


def visible_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags, common entities decoded."""
    out = html
    for hidden in (r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", r"<!--.*?-->"):
        out = F.regexp_replace(out, f"(?is){hidden}", " ")
    out = F.regexp_replace(out, r"(?is)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
