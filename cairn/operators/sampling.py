"""Seeded samples that don't hang on partitions: rows are ordered by md5(seed:id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"))


def subsample(df: DataFrame, n: int, seed: int, id_: str) -> DataFrame:
    """n rows; all of them where there are no more."""
    return df.orderBy(shuffled(F.col(id_), seed), id_).limit(n)


def quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, count, quota): n by share of rows, whole parts first, then one more to the largest remainders."""
    counts = df.groupBy(stratum).count()
    everything = Window.partitionBy(F.lit(0))
    raw = counts.withColumn("raw", F.lit(n) * F.col("count") / F.sum("count").over(everything))
    raw = raw.withColumn("whole", F.floor("raw")).withColumn("left", F.lit(n) - F.sum("whole").over(everything))
    order = Window.orderBy(F.desc(F.col("raw") - F.col("whole")), stratum)
    return raw.withColumn("i", F.row_number().over(order)).select(stratum, "count", (F.col("whole") + (F.col("i") <= F.col("left")).cast("int")).alias("quota"))


def stratified(df: DataFrame, stratum: str, n: int, seed: int, id_: str) -> DataFrame:
    """The quota's rows of each stratum."""
    wanted = F.broadcast(quotas(df, stratum, n).select(stratum, "quota"))
    most = wanted.agg(F.max("quota")).first()[0] or 0
    return first_rows(df, stratum, most, seed, id_).join(wanted, stratum).where(F.col("__i") <= F.col("quota")).drop("__i", "quota")


def first_rows(df: DataFrame, stratum: str, most: int, seed: int, id_: str) -> DataFrame:
    """The first rows of each stratum by hash, with their place; the bound on the place lets each task keep no more of a stratum before the shuffle."""
    order = Window.partitionBy(stratum).orderBy(shuffled(F.col(id_), seed), id_)
    return df.withColumn("__i", F.row_number().over(order)).where(F.col("__i") <= most)


def reservoir(df: DataFrame, stratum: str, size: int, seed: int, id_: str, quota: int = 0) -> DataFrame:
    """At most `size` rows of each stratum; a size under the quota that is drawn from it later is refused."""
    if size < quota:
        raise ValueError(f"a reservoir of {size} can't give {quota}")
    return first_rows(df, stratum, size, seed, id_).drop("__i")


def rows_of(df: DataFrame, id_: str, order: str, n: int) -> DataFrame:
    """The rows of the first n values of `order`: keys first, the wide rows by a semi-join."""
    first = df.select(id_, order).orderBy(order, id_).limit(n).select(id_)
    return df.join(F.broadcast(first), id_, "left_semi")


def split_queries(df: DataFrame, category: str, n: int, seed: int, id_: str, hot: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Queries, half from the categories with most rows (the top share, one at least) and half from the rest; and the base without them."""
    sizes = df.groupBy(category).count()
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.desc("count"), category))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    top = ranked.where(F.col("i") <= F.greatest(F.lit(1), F.floor(F.col("n") * hot))).select(category)
    queries = subsample(df.join(top, category, "left_semi"), n // 2, seed, id_).unionByName(subsample(df.join(top, category, "left_anti"), n - n // 2, seed, id_))
    return queries, df.join(queries.select(id_), id_, "left_anti")


def before_cutoff(df: DataFrame, at: str, cutoff: str | None = None) -> DataFrame:
    """Adds before: whether the time, as a string, comes before the cutoff; by default the middle element of the sorted times, found by counts of the distinct ones."""
    from cairn.operators.measures import cutoff_of

    cut = F.broadcast(cutoff_of(df.select(F.col(at).cast("string").alias("at")), cutoff).withColumnRenamed("cutoff", "__cut"))
    return df.join(cut).withColumn("before", F.col(at).cast("string") < F.col("__cut")).drop("__cut")


def truncated(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Texts over a limit of white-space tokens: None is not zero, so empty tables give nulls for shares."""
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return df.select(n.alias("n")).agg(F.count("*").alias("texts"), F.sum((F.col("n") > limit).cast("long")).alias("truncated"), F.avg((F.col("n") > limit).cast("double")).alias("fraction"), F.max("n").cast("long").alias("longest"))


def eligible(df: DataFrame, text: str, least: int, present: tuple[str, ...]) -> DataFrame:
    """Texts of enough characters whose other columns are there and not blank."""
    ok = F.length(F.trim(F.coalesce(text, F.lit("")))) >= least
    for c in present:
        ok = ok & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.where(ok)


#: Fixed value: how the abstract of a withdrawn record begins.
WITHDRAWN = "this paper has been withdrawn"


def eligible_records(df: DataFrame, least: int = 200) -> DataFrame:
    """Records (abstract, categories, update_date) with a long enough abstract, categories and a year, that aren't withdrawn."""
    from cairn.sources.loaders import year_of

    text = F.lower(F.trim(F.coalesce("abstract", F.lit(""))))
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return df.where((F.length(text) >= least) & there("categories") & there("update_date") & ~text.startswith(WITHDRAWN) & year_of(F.col("update_date")).isNotNull())
