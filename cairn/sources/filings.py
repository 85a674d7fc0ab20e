"""Annual filings: text of their markup, sections by numbered items, and whether a filing is taken."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The items of a filing in their order, and those of which one at least is wanted.
ITEMS = ["1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11", "12", "13", "14", "15", "16"]
CORE = ("1", "1A", "7", "8")
#: Bounds of a filing that is taken, of a page of contents, and of a table that is numbers.
LEAST_CHARS, LEAST_ITEMS, PROSE_CHARS, PROSE_ITEMS = 20_000, 6, 1_000, 4
NEAR, RUN, FRONT = 800, 6, 0.20
NUMERIC = 0.60
#: A heading's line, with a letter-spaced word, a number, perhaps a letter, a separator, and a title of up to 200 characters.
HEADING = re.compile(r"^[ \t]*(?:PART\s+[IV]+[ \t.\-–—:]*)?I[ \t]?T[ \t]?E[ \t]?M[ \t\n]{1,3}(\d{1,2})[ \t]*([A-C])?[ \t]*([.\-–—:)])?[ \t]*(.{0,200})$", re.I | re.M)
REJECTIONS = ("not_html", "too_short", "no_sections", "too_few_sections", "no_core_section", "sections_empty")

HIDDEN = [re.compile(p, re.S | re.I) for p in (r"<!--.*?-->", r"<(script|style)\b.*?</\1\s*>", r"<ix:header\b.*?</ix:header\s*>", r'<div[^>]*style="[^"]*display:\s*none[^"]*"[^>]*>.*?</div>')]
TABLE, ROW, CELL = (re.compile(p, re.S | re.I) for p in (r"<table\b.*?</table\s*>", r"<tr\b[^>]*>(.*?)</tr\s*>", r"<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"))
BLOCK, TAG, NUMBER = re.compile(r"</?(?:p|div|br|tr|li|h[1-6]|table|section|article)\b[^>]*>", re.I), re.compile(r"<[^>]+>"), re.compile(r"[\s$()\-–—+%.,0-9]*")


def cell_text(cell: str) -> str:
    return re.sub(r"[ \t\xa0]+", " ", html.unescape(TAG.sub(" ", cell))).strip()


def table_text(table: str) -> str:
    """Rows of cells, or nothing for a table that is mostly numbers or empty."""
    rows = [[cell_text(c) for c in CELL.findall(r)] for r in ROW.findall(table)]
    cells = [c for r in rows for c in r]
    if not cells or sum(NUMBER.fullmatch(c) is not None for c in cells) >= NUMERIC * len(cells):
        return "\n"
    lines = (" | ".join(filter(None, r)) for r in rows)
    return "\n" + "\n".join(filter(None, lines)) + "\n"


def filing_text(markup: str) -> str:
    """What a reader sees: hidden parts go, tables become rows or go, blocks become lines; characters in their compatible forms, spaces and blank lines single."""
    start = re.search("<TEXT>", markup, re.I)
    out = markup[start.end() :] if start else markup
    for hidden in HIDDEN:
        out = hidden.sub(" ", out)
    out = TABLE.sub(lambda m: table_text(m[0]), out)
    out = html.unescape(TAG.sub(" ", BLOCK.sub("\n", out)))
    out = re.sub(r"[ \t\xa0]+", " ", unicodedata.normalize("NFKC", out))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.strip() for line in out.split("\n"))).strip()


def longest_rising(ranks: list[int]) -> list[int]:
    """Places of a longest strictly rising run of choices, by patience sorting; of several the one found first."""
    tops, at, before = [], [], []
    for i, r in enumerate(ranks):
        k = bisect_left(tops, r)
        tops[k : k + 1] = [r]
        at[k : k + 1] = [i]
        before.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def sections(text: str) -> list[tuple[str, str, int, int]]:
    """(item, title, start, end). Headings that are a page of contents (a run near the front, close together, with rising items) or out of order don't count; a section reaches to the next one."""
    order = {item: i for i, item in enumerate(ITEMS)}
    found = []
    for m in HEADING.finditer(text or ""):
        item, title = m[1] + (m[2] or "").upper(), m[4].strip(" .:-–—|")
        if item in order and (m[3] or not title[:1].islower()):  # else a sentence that refers to an item
            found.append((item, title, m.start()))
    runs: list[list[tuple[str, str, int]]] = []
    for h in found:
        if runs and h[2] - runs[-1][-1][2] <= NEAR and order[h[0]] > order[runs[-1][-1][0]]:
            runs[-1].append(h)
        else:
            runs.append([h])
    kept = [h for run in runs if len(run) < RUN or run[0][2] > FRONT * len(text) for h in run]
    kept = [kept[i] for i in longest_rising([order[h[0]] for h in kept])]
    ends = [h[2] for h in kept[1:]] + [len(text or "")] * bool(kept)
    return [(item, title, a, b) for (item, title, a), b in zip(kept, ends, strict=True)]


def verdict(markup: str | None) -> tuple[str | None, str, list[tuple[str, str, int, int]]]:
    """(rejection or None, text, sections) of one filing's markup."""
    if not markup or not re.search(r"<(html|body|div|p|table)\b", markup[:20_000], re.I):
        return "not_html", "", []
    text = filing_text(markup)
    found = sections(text)
    items = {s[0] for s in found}
    prose = sum(b - a >= PROSE_CHARS for _, _, a, b in found)
    checks = ((len(text) < LEAST_CHARS, "too_short"), (not found, "no_sections"), (len(items) < LEAST_ITEMS, "too_few_sections"), (not items & set(CORE), "no_core_section"), (prose < PROSE_ITEMS, "sections_empty"))
    return next((why for bad, why in checks if bad), None), text, found


def filings(pages: DataFrame, id_: str, markup: str) -> DataFrame:
    """(id, outcome, reason, text, sections): accepted filings with their text and sections, rejected ones with their reason."""
    kind = pages.schema[id_].dataType.simpleString()

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, page in zip(part.iloc[:, 0], part.iloc[:, 1], strict=True):
                why, text, found = verdict(page)
                taken = [{"item": i, "title": t, "start": a, "end": b} for i, t, a, b in found] if why is None else []
                rows.append((key, "rejected" if why else "accepted", why, None if why else text, taken))
            yield pd.DataFrame(rows, columns=[id_, "outcome", "reason", "text", "sections"])

    return pages.select(id_, markup).mapInPandas(f, f"{id_} {kind}, outcome string, reason string, text string, sections array<struct<item: string, title: string, start: int, end: int>>")


def section_table(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, item, title, start, end) of every section of plain texts."""
    kind = docs.schema[id_].dataType.simpleString()

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(key, *s) for key, t in zip(part.iloc[:, 0], part.iloc[:, 1], strict=True) for s in sections(t or "")]
            yield pd.DataFrame(rows, columns=[id_, "item", "title", "start", "end"])

    return docs.select(id_, text).mapInPandas(f, f"{id_} {kind}, item string, title string, start int, end int")


def section_statistics(docs: DataFrame, found: DataFrame, id_: str = "doc_id") -> DataFrame:
    """One row: documents, sections, their number a document and their lengths (percentiles cut to whole numbers), and documents that have each item."""
    per = docs.select(id_).join(found.groupBy(id_).agg(F.count("*").alias("n")), id_, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    cut = lambda c, p: F.coalesce(F.floor(F.percentile(c, F.lit(p))).cast("long"), F.lit(0))
    length = F.col("end") - F.col("start")
    one = per.agg(F.count("*").alias("documents"), cut("n", 0.5).alias("sections_p50"), cut("n", 0.95).alias("sections_p95"), F.coalesce(F.max("n"), F.lit(0)).alias("sections_most"), F.round(F.avg("n"), 2).alias("sections_mean"))
    two = found.withColumn("chars", length).agg(F.count("*").alias("sections"), cut("chars", 0.05).alias("chars_p5"), cut("chars", 0.5).alias("chars_p50"), cut("chars", 0.95).alias("chars_p95"), F.coalesce(F.max("chars"), F.lit(0)).alias("chars_most"))
    return one.join(two)


def item_coverage(found: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(item, documents) for every item there is, 0 where none has it."""
    every = found.sparkSession.createDataFrame([(i,) for i in ITEMS], "item string")
    return F.broadcast(every).join(found.groupBy("item").agg(F.countDistinct(id_).alias("documents")), "item", "left").fillna(0, ["documents"])
