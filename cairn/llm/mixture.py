"""Operator 1: mixing sources to target weights by iterative proportional fitting. Built-in functions only.

Token counts are summed over cells of source, language and topic. Each round scales the cells' weights so that
every margin in turn has its target shares (raking), for ROUNDS rounds and then until every margin is within TOLERANCE of
its targets. Margins that can't be met (more rounds no longer bring them nearer) are reported by a warning. The weights are scaled to the
token budget, and a cell's sampling probability is its weight over its tokens, at most 1, with what full cells can't
give shared among the others (calibration). A document is sampled where a uniform number from the MD5 of
its id lies below its cell's probability.

Targets default to tempered shares: a value's share of tokens to the power TEMPER, so that small ones gain.
Only cells, partially aggregated, are raked; documents are never grouped.

Ties don't occur: cells are told apart by their values, and a document at its cell's probability exactly isn't sampled. A null source, language, topic or text is the empty string; texts without words weigh nothing, and their cell's
probability holds for them too. A null id hashes as ''. Rows with one id share their fate. Other columns are kept by `mixed`.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import Stage

MARGINS = ("source", "lang", "topic")
ROUNDS, FILLS = 12, 6
#: Largest distance of a margin's shares from its targets (half the sum of differences), looked at every TURNS rounds.
TOLERANCE, TURNS = 1e-6, 4
#: Raking gives up where this share of the distance, at least, isn't gained twice in a row.
GAIN = 0.001
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Cells up to this count are broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Signs of a genre: its characters, and in how many characters of a text one of them must be, or more. The first that holds names it.
GENRES = (("capitals", "[A-Z]", 3), ("figures", "[0-9]", 8), ("code", r"[{}();<>=\[\]]", 20), ("table", r"[|\t]", 25), ("marks", r"[!-/:-@\[-`{-~]", 7))


def topic_of(text: Column) -> Column:
    """The topic, as far as a text without one tells it: a genre by its measured shares of characters: capitals,
    digits, brackets, column marks and other marks; the rest is prose by length."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    of = lambda pattern: F.regexp_count(text, F.lit(pattern))
    out = F.when(n == 0, F.lit(""))
    for name, pattern, share in GENRES:
        out = out.when(of(pattern) * share >= n, name)
    return out.when(n < 1000, "notes").otherwise("prose")


def uniform(doc_id: Column) -> Column:
    first = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(first, 16, 10).cast("double") / F.lit(2.0**32)


def margined(docs: DataFrame, topic: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, tokens) for every row."""
    margin = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), margin(F.col("source")).alias("source"), margin(F.col("lang")).alias("lang"), margin(topic_of(F.col(text)) if topic is None else topic).alias("topic"), tokens_of(F.col(text)).alias("tokens")
    )


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds weight, shares that sum to 1. `targets`: wanted shares of each margin's values, for margins that aren't tempered."""
    targets = targets or {}
    everything = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        of = Window.partitionBy(m)
        if m in targets:
            goal = F.create_map(*[F.lit(x) for kv in targets[m].items() for x in kv])
            cells = cells.withColumn(f"goal_{m}", F.coalesce(F.try_element_at(goal, F.col(m)), F.lit(0.0)))
        else:
            share = F.sum("weight").over(of) / F.sum("weight").over(everything)
            one = F.row_number().over(of.orderBy(*[x for x in MARGINS if x != m])) == 1
            cells = cells.withColumn("s", F.pow(share, F.lit(TEMPER[m]))).withColumn("one", one)
            cells = cells.withColumn(f"goal_{m}", F.col("s") / F.sum(F.when(F.col("one"), F.col("s"))).over(everything)).drop("s", "one")
    held = written = Stage(cells)
    turn, before, stuck = 0, float("inf"), 0
    while True:
        step = held.df
        for m in MARGINS:
            step = step.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"goal_{m}"), F.sum("weight").over(Window.partitionBy(m))), F.lit(0.0)))
        turn += 1
        if turn % TURNS:
            held = _Lazy(step)
            continue
        new = Stage(step)
        written.drop()
        held = written = new
        if turn < ROUNDS:
            continue
        away = distances(held.df, targets)
        worst = max(away.values())
        stuck = stuck + 1 if worst > before * (1 - GAIN) else 0
        before = worst
        if worst <= TOLERANCE:
            break
        if stuck == 2:
            warnings.warn(f"margins that can't be met, with their distance after {turn} rounds: { {m: d for m, d in away.items() if d > TOLERANCE} }", stacklevel=2)
            break
    return held.df.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(everything)), F.lit(0.0))).drop(*(f"goal_{m}" for m in MARGINS))


def distances(cells: DataFrame, targets: dict[str, dict[str, float]]) -> dict[str, float]:
    """How far the shares of each margin are from its targets; targets of values without cells are missed."""
    everything = Window.partitionBy(F.lit(0))
    of = [
        cells.groupBy(m).agg(F.sum("weight").alias("w"), F.first(f"goal_{m}").alias("goal")).select("goal", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(everything)), F.lit(0.0)).alias("share"))
        .agg(F.sum(F.abs(F.col("share") - F.col("goal"))).alias("off"), F.sum("goal").alias("held")).select(F.lit(m).alias("m"), "off", "held")
        for m in MARGINS
    ]
    found = of[0].unionByName(of[1]).unionByName(of[2]).collect()
    missing = lambda r: max(0.0, sum(targets[r.m].values()) - (r.held or 0.0)) if r.m in targets and r.off is not None else 0.0
    return {r.m: ((r.off or 0.0) + missing(r)) / 2 for r in found}


class _Lazy:
    """A step that is not written."""

    def __init__(self, df: DataFrame):
        self.df = df


def calibrated(cells: DataFrame, fraction: float) -> DataFrame:
    """Adds probability: weights scaled to `fraction` of all tokens, full cells passing on what they can't give."""
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("tokens").over(everything) * F.lit(fraction)
    out = cells.withColumn("probability", F.lit(0.0))
    for _ in range(FILLS):
        full = F.col("probability") >= 1.0
        left = total - F.coalesce(F.sum(F.when(full, F.col("tokens"))).over(everything), F.lit(0))
        open_weight = F.sum(F.when(~full, F.col("weight"))).over(everything)
        out = out.withColumn("scale", F.try_divide(left, open_weight))
        out = out.withColumn("probability", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("weight") * F.col("scale"), F.col("tokens")), F.lit(fraction))))).drop("scale")
    return out


def probabilities(docs: DataFrame, *, fraction: float = 0.5, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, sampled for every row."""
    known = Stage(margined(docs, topic))
    cells = known.df.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    fitted = Stage(calibrated(raked(cells, targets), fraction))
    small = fitted.df.drop("tokens")
    if small.count() <= BROADCAST_CELLS:
        small = F.broadcast(small)
    out = known.df.join(small, list(MARGINS))
    return out.select("doc_id", *MARGINS, "tokens", "weight", "probability", (uniform(F.col("doc_id")) < F.col("probability")).alias("sampled"))


def mixed(docs: DataFrame, *, fraction: float = 0.5, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled rows of `docs`, with the columns it has, and their probability."""
    known = margined(docs)
    cells = known.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    fitted = Stage(calibrated(raked(cells, targets), fraction)).df.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("probability").alias("mix_probability"))
    if fitted.count() <= BROADCAST_CELLS:
        fitted = F.broadcast(fitted)
    margin = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    same = (margin(F.col("source")) == F.col("__source")) & (margin(F.col("lang")) == F.col("__lang")) & (topic_of(F.col("text")) == F.col("__topic"))
    joined = docs.join(fitted, same)
    return joined.where(uniform(F.col("doc_id")) < F.col("mix_probability")).select(*docs.columns, "mix_probability")


def oracle() -> str:
    """The same in DuckDB's SQL, round by round."""
    text = "coalesce(text, '')"
    of = lambda pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
    signs = " ".join(f"WHEN {of(pattern)} * {share} >= length({text}) THEN '{name}'" for name, pattern, share in GENRES)
    topic = f"CASE WHEN {text} = '' THEN '' {signs} WHEN length({text}) < 1000 THEN 'notes' ELSE 'prose' END"
    parts = [
        f"known AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, CAST(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) AS weight FROM known GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"s_{m} AS MATERIALIZED (SELECT {m}, pow(sum(weight) / (SELECT sum(weight) FROM cells), {TEMPER[m]}) AS s FROM cells GROUP BY {m})")
        parts.append(f"goal_{m} AS MATERIALIZED (SELECT {m}, s / (SELECT sum(s) FROM s_{m}) AS goal_{m} FROM s_{m})")
    parts.append("w0 AS MATERIALIZED (SELECT * FROM cells " + " ".join(f"JOIN goal_{m} USING ({m})" for m in MARGINS) + ")")
    n = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * (goal_{m} / nullif(sum(weight) OVER (PARTITION BY {m}), 0)), 0) AS weight) FROM w{n})")
            n += 1
    parts.append(f"p0 AS MATERIALIZED (SELECT * REPLACE (coalesce(weight / nullif(sum(weight) OVER (), 0), 0) AS weight), CAST(0 AS DOUBLE) AS probability FROM w{n})")
    for i in range(FILLS):
        scale = "((sum(tokens) OVER () * CAST(0.5 AS DOUBLE) - coalesce(sum(tokens) FILTER (probability >= 1) OVER (), 0)) / nullif(sum(weight) FILTER (probability < 1) OVER (), 0))"
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN probability >= 1 THEN 1 ELSE least(1, coalesce(weight * {scale} / nullif(tokens, 0), 0.5)) END AS probability) FROM p{i})")
    u = "CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, known.tokens, round(weight, 9) AS weight, round(probability, 9) AS probability, {u} < probability AS sampled FROM known JOIN p{FILLS} USING (source, lang, topic)"
