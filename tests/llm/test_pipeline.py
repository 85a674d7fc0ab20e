"""The pipeline on the smallest tables against plain versions of its stages."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from cairn.llm import secret_scan
from cairn.llm.shared import cut, table

SF = "/root/testdata/sf0.001"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_each_stage_keeps_what_it_should(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF))
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and after
        if name != "mixture":
            assert out.columns == columns
        if name in ("language", "near_duplicates", "decontamination"):
            assert all(after[i] == before[i] for i in after)
        if name == "language":
            assert len(after) >= 0.95 * len(before)
        if name == "near_duplicates":
            sets = {}
            for i, r in before.items():
                w = r.text.lower().split()
                sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            kept = list(after)
            assert not any(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for x, a in enumerate(kept) for b in kept[:x])
        if name == "secrets":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) or r.text == before[i].text for i, r in after.items())
        docs = out


def test_rows_go_by_what_they_hold(spark):
    text = {"A": "one two three four five six", "Z": "seven eight nine ten eleven twelve", "Q": "red green blue black white grey", "e": ""}
    rows = [(1, "A"), (2, "A"), (2, "Z"), (3, "Q"), (3, "Q"), (None, "A"), (None, "e"), (4, "e"), (4, "e")]
    docs = spark.createDataFrame([(i, text[t], "en", "s", 9, {"k": 1}) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str((i, text[t])) for i, t in [(1, "A"), (2, "Z"), (3, "Q"), (None, "e"), (4, "e"), (4, "e")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_run_is_its_stages(spark):
    """run() over the whole smallest tables, against the stages' own plain rules."""
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) <= set(before) and 0 < len(out) < len(before)
    words = lambda t, pattern: re.findall(pattern, t.translate({c: c + 32 for c in range(65, 91)}))
    held = {r.item_id: words(r.text, PLAIN) for r in table(spark, SF, "benchmark").collect()}
    windows = {(n, tuple(w[i : i + n])) for w in held.values() if w for n in [min(10, len(w))] for i in range(len(w) - n + 1)}
    sizes = {n for n, _ in windows}
    sets = {}
    for i, r in out.items():
        w = words(before[i].text, PLAIN)
        assert not any((n, tuple(w[k : k + n])) in windows for n in sizes for k in range(len(w) - n + 1))
        v = words(before[i].text, r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(v[k : k + 5]) for k in range(max(1, len(v) - 4))}
        assert 0 < r.mix_probability <= 1 and r.text == before[i].text or secret_scan.MASK in r.text
    kept = list(out)
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for x, a in enumerate(kept) for b in kept[:x])


def test_stages_of_odd_rows(spark):
    """Nulls in all columns, repeated rows, an empty and a long text, extra columns; and no rows at all."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the quick brown fox jumps over the lazy dog again", "en", None, 9), (3, "word " * 100_000, "en", "s", 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("weight", F.lit(1)).withColumn("class", F.lit("c"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        if name in ("near_duplicates", "decontamination", "secrets"):
            assert out.count() == len(rows), name
