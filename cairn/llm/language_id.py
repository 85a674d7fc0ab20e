"""Operator 4: language identification by Bayesian fusion of evidence.

Evidence of a row: its text (byte trigrams under one smoothed table a language, fitted on a bounded
sample of labelled texts), the language its markup declares, and where it lies: a prior for its host,
smoothed towards that of its registered domain, then of its address suffix, then of all rows. Priors come from grouped
aggregation of the text's own soft verdicts, so that no host is collected; how far markup can be
believed is counted the same way, as P(declared | language). Log-evidence is added up; the text's is
divided by TEMPERATURE, as its trigrams aren't independent.

A row is rejected (`und`) when its text has fewer than LEAST_TRIGRAMS trigrams of letters and nothing is declared,
or when its best language has a posterior below ACCEPT.

Null texts are empty: only markup and place speak. A null or missing host, suffix or declaration is no
evidence. Without labelled texts every language is as likely and rows are judged by the rest, or
rejected without languages at all. Every row gives a row; repeated rows too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.shared import Stage, small_batches, small_table, without

SLOTS = 1 << 16
TEMPERATURE = 4.0
ACCEPT, LEAST_TRIGRAMS = 0.5, 3
#: Pseudo-rows of a level's prior that come from the level above.
STRENGTH = 10.0
#: Bound of the training sample: rows of a language and characters of a row.
SAMPLE, SAMPLE_CHARS = 400, 20_000
#: Lower-cases A-Z, and turns what is neither a letter nor beyond ASCII into a space.
FOLD = tk.LOWER.copy()
FOLD[[b for b in range(128) if not chr(FOLD[b]).isalpha()]] = 32


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams of each text, and bounds; trigrams without a letter have slot -1."""
    x = FOLD[data].astype(np.int64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    slot = ((code * 2654435761) >> 12) % SLOTS
    slot[code == 0x202020] = -1
    inside = np.ones(len(slot), dtype=bool)
    for edge in at[1:-1]:
        inside[max(0, edge - 2) : edge] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return slot[inside], kept[np.minimum(at, len(slot))]


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (SLOTS, languages) of log-probabilities

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of each text (its mean language taken off) and its trigrams with letters."""
        out, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for a, b in tk.runs(texts):
            slot, at = trigrams(*tk.chars(texts.slice(a, b - a)))
            real = slot >= 0
            seen[a:b] = tk.sums(real.astype(np.int64), at)
            for i in range(len(self.languages)):
                out[a:b, i] = tk.sums(np.where(real, self.table[slot, i], 0.0), at)
        return out - out.mean(axis=1, keepdims=True) if len(self.languages) else out, seen


def sampled(usable: DataFrame) -> dict[str, list[int]]:
    """The SAMPLE least hashes of each language of (lang, h). Hashes are even, so those under a bound that should hold a few more are collected; the
    bound is raised for languages whose texts repeat."""
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    share = {name: min(1.0, 2 * SAMPLE / n) for name, n in sizes.items()}
    found: dict[str, list[int]] = {}
    while share:
        bounds = [int(-(2**63) + min(s * 2**64, 2**64 - 1)) for s in share.values()]
        under = usable.join(F.broadcast(small_table(usable.sparkSession, lang=list(share), bound=bounds)), "lang").where(F.col("h") <= F.col("bound"))
        held: dict[str, list[int]] = {name: [] for name in share}
        for r in under.select("lang", "h").distinct().collect():  # about 2 SAMPLE a language
            held[r.lang].append(r.h)
        for name, hashes in held.items():
            if len(hashes) >= SAMPLE or share[name] >= 1:
                found[name] = sorted(hashes)[:SAMPLE]
                del share[name]
            else:
                share[name] = min(1.0, 4 * share[name])
    return found


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """From a bounded sample of texts for each label, in the order of a hash; null labels and texts aren't used."""
    usable = labelled.where(F.col(lang).isNotNull() & (F.length(text) <= SAMPLE_CHARS) & (F.length(text) > 0)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = usable.withColumn("h", F.xxhash64("text"))
    picked = sampled(usable)
    languages = sorted(picked)
    texts: dict[str, list[str]] = {name: [] for name in languages}
    if picked:
        last = small_table(usable.sparkSession, lang=languages, last=[picked[name][-1] for name in languages])
        taken = usable.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last"))
        for r in taken.dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect():  # at most SAMPLE for each language
            texts[r.lang].append(r.text)
    table = np.zeros((SLOTS, len(languages)))
    for i, name in enumerate(languages):
        slot, _ = trigrams(*tk.chars(pa.array(texts[name], pa.string())))
        count = np.bincount(slot[slot >= 0], minlength=SLOTS)
        table[:, i] = np.log(count + 0.1) - np.log(count.sum() + 0.1 * SLOTS)
    return TextModel(languages, table)


def visible(html: Column) -> Column:
    """What a page shows, roughly: without scripts, styles, comments, tags and entities."""
    hidden = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(hidden, r"(?s)<[^>]*>|&#?\w+;", " ")


def declared_in(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, else null."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"(?s)://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


def identify(rows: DataFrame, model: TextModel, *, text: Column, declared: Column | None = None, host: Column | None = None, keep: tuple[str, ...]) -> DataFrame:
    """The `keep` columns, lang (`und` if rejected), confidence, declared, host and the text's own best language."""
    small_batches(rows.sparkSession)
    absent = F.lit(None).cast("string")
    narrow = rows.select(*keep, text.alias("__text"), (absent if declared is None else declared).alias("__declared"), (absent if host is None else host).alias("__host"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = len(model.languages)
    carried = [*keep, "__declared", "__host"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = tk.filled(batch.column("__text"))
            log, seen = model.evidence(texts)
            log = log / TEMPERATURE
            soft = np.exp(log - log.max(axis=1, keepdims=True)) if size else log
            soft = soft / soft.sum(axis=1, keepdims=True) if size else soft
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), size).cast(pa.list_(pa.float64())) if size else pa.array([[]] * len(texts), pa.list_(pa.float64())) for x in (log, soft)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *lists, pa.array(seen)], names=[*carried, "__log", "__soft", "__seen"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in narrow.schema if x.name != "__text")
    judged = narrow.mapInArrow(tk.frugal(f), f"{fields}, __log array<double>, __soft array<double>, __seen long")
    if not size:
        return judged.select(*keep, F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.col("__declared").alias("declared"), F.col("__host").alias("host"), absent.alias("text_lang"))
    labels = F.split("__host", r"\.")
    places = Stage(judged.withColumn("__domain", F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("__host"))).withColumn("__suffix", F.element_at(labels, -1)))
    base = places.df
    sums = [F.sum(F.get("__soft", F.lit(i))).alias(f"n{i}") for i in range(size)]
    counts = lambda key: base.where(F.col(key).isNotNull() & (F.col("__seen") >= LEAST_TRIGRAMS)).groupBy(key).agg(*sums)
    array = lambda make: F.array(*(make(i) for i in range(size)))
    total = base.where(F.col("__seen") >= LEAST_TRIGRAMS).agg(*sums).first()
    rows_all = sum(total[i] or 0.0 for i in range(size))
    overall = array(lambda i: F.lit(((total[i] or 0.0) + 1.0) / (rows_all + size)))

    def smoothed(level: DataFrame, above: Column, name: str) -> DataFrame:
        n = sum((F.col(f"n{i}") for i in range(1, size)), F.col("n0"))
        return level.withColumn(name, array(lambda i: (F.col(f"n{i}") + STRENGTH * F.get(above, F.lit(i))) / (n + STRENGTH))).drop(*(f"n{i}" for i in range(size)))

    suffix = smoothed(counts("__suffix"), overall, "p_suffix")
    domain = counts("__domain").withColumn("__suffix", F.element_at(F.split("__domain", r"\."), -1)).join(suffix, "__suffix", "left")
    domain = smoothed(domain, F.coalesce("p_suffix", overall), "p_domain").select("__domain", "p_domain")
    hosts = base.where(F.col("__host").isNotNull()).select("__host", "__domain", "__suffix").distinct()
    hosts = hosts.join(counts("__host"), "__host", "left").fillna(0.0, [f"n{i}" for i in range(size)]).join(domain, "__domain", "left").join(suffix, "__suffix", "left")
    hosts = Stage(smoothed(hosts, F.coalesce("p_domain", "p_suffix", overall), "p_host").select("__host", "p_host"))
    believed = base.where(F.col("__declared").isNotNull() & (F.col("__seen") >= LEAST_TRIGRAMS)).groupBy("__declared").agg(*sums)
    declared_log = believed.select("__declared", array(lambda i: F.log((F.col(f"n{i}") + 0.5) / F.lit((total[i] or 0.0) + 1.0))).alias("d_log"))
    joined = base.join(hosts.df, "__host", "left").join(declared_log, "__declared", "left")
    score = array(lambda i: F.get("__log", F.lit(i)) + F.log(F.get(F.coalesce("p_host", overall), F.lit(i))) + F.coalesce(F.get("d_log", F.lit(i)), F.lit(0.0)))
    joined = joined.withColumn("__score", score).withColumn("__top", F.array_max("__score"))
    joined = joined.withColumn("__sum", F.aggregate("__score", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("__top")))).withColumn("confidence", F.lit(1.0) / F.col("__sum"))
    names = F.array(*map(F.lit, model.languages))
    best = lambda scores, top: F.get(names, (F.array_position(scores, top) - 1).cast("int"))
    silent = (F.col("__seen") < LEAST_TRIGRAMS) & F.col("__declared").isNull()
    lang = F.when(silent | (F.col("confidence") < ACCEPT), "und").otherwise(best(F.col("__score"), F.col("__top")))
    return joined.select(*keep, lang.alias("lang"), "confidence", F.col("__declared").alias("declared"), F.col("__host").alias("host"), F.when(F.col("__seen") >= LEAST_TRIGRAMS, best(F.col("__log"), F.array_max("__log"))).alias("text_lang"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    return identify(pages, model, text=visible(F.col("html")), declared=declared_in(F.col("html")), host=host_of(F.col("url")), keep=("page_id",))


def accepted(docs: DataFrame, model: TextModel) -> DataFrame:
    """Rows of `docs` whose language is identified, unchanged; the source stands for the host."""
    keyed = docs.select(F.xxhash64("doc_id", "text", "source").alias("__gone"), "text", "source")
    out = identify(keyed, model, text=F.col("text"), host=F.col("source"), keep=("__gone",))
    return without(docs, out.where(F.col("lang") == "und").select("__gone"), F.xxhash64(docs["doc_id"], docs["text"], docs["source"]) == F.col("__gone"))
