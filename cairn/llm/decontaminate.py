"""Operator 10: benchmark decontamination by winnowing. Built-in functions only.

Each text becomes hashes of its k-word grams; every window of `span - k + 1` successive
hashes keeps its minimum. Two texts that share `span` words share that whole window and
so the kept minimum, which makes the join on kept minima find every shared span. A hit
is then extended to the spans around it, compared by the two or more grams that cover
them (twice 64 bits and more), so that only spans that agree in all words stay.

An item of fewer than `span` words, but not none, is one span of its own length; its
grams of that length are compared as a whole, by one hash of 64 bits and the length.

Documents: a row for each row, repeated ones too; null texts have no words; a null id is an
id like any other. Items: rows with the same id are one item, a null id is the id ''.
With no items every document comes back clean. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import cut

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark fingerprints are broadcast up to this count (some 32 MB); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def shifted(a: str, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def with_grams(df: DataFrame, k: int, span: int) -> DataFrame:
    """Adds n, wh (word hashes), gram (hashes of k words) and low (the minimum of each window of grams).

    Trailing entries, which cover fewer words than they should, are never read: positions go to n - span.
    """
    df = df.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", F.size("wh").cast("long")).drop("w")

    def folded(df: DataFrame, source: str, to: str, width: int, join) -> DataFrame:
        """Combines `width` successive entries by doubling."""
        have, name = 1, source
        while have < width:
            step = min(have, width - have)
            nxt = to if have + step == width else f"{to}{have + step}"
            df = df.withColumn(nxt, F.zip_with(F.col(name), shifted(name, step), join))
            have, name = have + step, nxt
        return df if name == to else df.withColumn(to, F.col(name))

    df = folded(df, "wh", "gram", k, lambda a, b: F.xxhash64(a, b))
    return folded(df, "gram", "low", span - k + 1, lambda a, b: F.least(a, b))


def key_of(df: DataFrame, k: int, span: int, at: Column, grams: Column) -> list[Column]:
    """The span's grams at its start and its end, which cover all its words as 2k >= span."""
    return [F.get(grams, at).alias("a"), F.get(grams, at + (span - k)).alias("b")]


def benchmark_spans(items: DataFrame, k: int, span: int, text: str, item_id: str) -> DataFrame:
    """(item, len, fp, a, b) of every span of every item."""
    base = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    g = with_grams(base, k, span)
    long = (
        g.where(F.col("n") >= span)
        .select("item", "gram", "low", F.explode(F.sequence(F.lit(0), (F.col("n") - span).cast("int"))).alias("s"))
        .select("item", F.lit(span).alias("len"), F.get("low", F.col("s")).alias("fp"), *key_of(g, k, span, F.col("s"), F.col("gram")))
    )
    whole = F.xxhash64(F.col("n"), F.col("wh"))
    short = g.where((F.col("n") > 0) & (F.col("n") < span)).select("item", F.col("n").cast("int").alias("len"), whole.alias("fp"), whole.alias("a"), F.col("n").alias("b"))
    return long.unionByName(short).distinct()


def hits(
    docs: DataFrame, items: DataFrame, *, span: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each row: doc_id, text_hash, n_words, spans (array of s, len, sorted), items (sorted ids)."""
    if not 2 * k >= span > k:
        raise ValueError("two grams must cover a span: k < span <= 2 k")
    spans = cut(benchmark_spans(items, k, span, item_text, item_id))
    lengths = sorted(r.len for r in spans.select("len").distinct().collect() if r.len < span)  # at most span - 1 values
    window = span - k + 1

    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words(F.col(text)).alias("w"))
    g = with_grams(base, k, span)
    last = (F.col("n") - span).cast("int")

    def kept(low: Column, j: Column) -> Column:
        """A minimum is kept where it differs from the one before; in periodic text, also every time the window has passed."""
        here = F.get(low, j)
        return (j == 0) | (here != F.get(low, j - 1)) | ((j >= window) & (here == F.get(low, j - F.lit(window))))

    g = g.withColumn("at", F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda j: kept(F.col("low"), j))).otherwise(F.array().cast("array<int>")))
    entry = lambda p, ln, fp, grams: F.struct(p.alias("p"), ln.alias("len"), fp.alias("fp"), grams.alias("grams"))
    nothing = F.array().cast("array<bigint>")
    marks = [
        F.array(entry(F.lit(-1), F.lit(0), F.lit(None).cast("long"), nothing)),  # carries n for documents without a hit
        F.transform("at", lambda p: entry(p, F.lit(span), F.get("low", p), F.slice("gram", p + 1, F.lit(span - k + window)))),
    ]
    none = F.array().cast("array<struct<p:int,len:int,fp:bigint,grams:array<bigint>>>")

    def whole(width: int) -> Column:
        """All grams of a short item's length. (The lambda takes one argument: a second would be the index.)"""
        ends = (F.col("n") - width).cast("int")
        made = F.transform(F.sequence(F.lit(0), F.greatest(ends, F.lit(0))), lambda p: entry(p, F.lit(width), F.xxhash64(F.lit(width).cast("long"), F.slice("wh", p + 1, F.lit(width))), nothing))
        return F.when(ends >= 0, made).otherwise(none)

    marks += [whole(n) for n in lengths]
    marked = g.select("doc_id", "text_hash", "n", F.explode(F.concat(*marks)).alias("m")).select("doc_id", "text_hash", "n", "m.*")

    small = spans.count() <= BROADCAST_ROWS
    bounded = F.broadcast if small else (lambda df: df)
    found = marked.join(bounded(spans.select("fp").distinct().withColumn("listed", F.lit(True))), "fp", "left").where(F.col("listed") | (F.col("p") < 0))
    # a hit stands for the spans that start in its window
    starts = F.when(F.col("len") == span, F.sequence(F.col("p"), F.least(F.col("p") + (window - 1), (F.col("n") - span).cast("int")))).otherwise(F.array("p"))
    at = F.col("s") - F.col("p")
    around = found.withColumn("s", F.explode(starts)).select(
        "doc_id", "text_hash", "n", "s", "len",
        F.when(F.col("len") == span, F.get("grams", at)).otherwise(F.col("fp")).alias("a"),
        F.when(F.col("len") == span, F.get("grams", at + (span - k))).otherwise(F.col("len").cast("long")).alias("b"),
    )
    keys = spans.select("a", "b", "len").distinct().withColumn("span_id", F.xxhash64("a", "b", "len"))
    agreed = around.join(bounded(keys), ["a", "b", "len"], "left").where(F.col("span_id").isNotNull() | (F.col("s") < 0))
    per_doc = agreed.groupBy("doc_id", "text_hash").agg(
        F.max("n").alias("n_words"),
        F.sum((F.col("s") < 0).cast("int")).cast("int").alias("rows"),  # of the same id and text
        F.sort_array(F.collect_set(F.when(F.col("s") >= 0, F.struct("s", "len")))).alias("spans"),
        F.collect_set("span_id").alias("ids"),
    )
    per_doc = cut(per_doc)
    owners = spans.select(F.xxhash64("a", "b", "len").alias("span_id"), "item").distinct()
    owned = (
        per_doc.select("doc_id", "text_hash", F.explode("ids").alias("span_id"))
        .join(bounded(owners), "span_id")
        .groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    joined = per_doc.join(owned, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left")
    joined = joined.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return joined.select("doc_id", "text_hash", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(spans: Column) -> Column:
    """Words covered by sorted (s, len) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["s"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(x["s"], acc["end"]))).alias("n"))

    return F.aggregate(spans, start, step)["n"].cast("long")


def contamination(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items, contaminated."""
    found = hits(docs, items, **how)
    return found.withColumn("n_hit", hit_words(F.col("spans"))).withColumn("contaminated", F.col("n_hit") > 0).drop("spans")


LETTERS = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {SQL_WORDS} AS w FROM benchmark),
spans AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k
          FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
runs AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM spans) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, s, runs.n, item FROM runs JOIN spans USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
owned AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN owned USING (doc_id)
"""
