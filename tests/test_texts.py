import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.operators import chunking, duplicates, sampling
from cairn.operators.chunking import Tokens, derive_offsets, fixed, floored, packed, sentence, sentence_spans, structure, windows
from cairn.sources import bridge, filings, loaders

TEXT = "One two three. Four five six! Seven eight? " * 20


def test_sentences_cover_the_text():
    for text in (TEXT, 'He said "go." Then left.\n\nnew part. and small', "", "x", "A.\n \nB"):
        spans = sentence_spans(text)
        assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans)
    assert len(sentence_spans("one. two. Three")) == 2


def test_windows_are_strides():
    for n in range(40):
        for size in range(1, 9):
            for overlap in range(size):
                want = []
                for lo in range(0, max(n, 1), size - overlap):
                    hi = min(lo + size, n)
                    want += [(lo, hi)] if hi > lo else []
                    if hi >= n:
                        break
                assert windows(n, size, overlap) == want
    with pytest.raises(ValueError):
        windows(5, 3, 3)


def test_packing_reaches_its_overlap():
    tokens = Tokens(TEXT)
    assert packed(TEXT, 12, 0, tokens)[1][0] == packed(TEXT, 12, 0, tokens)[0][1]
    for overlap in (1, 2, 3, 4):
        chunks = packed(TEXT, 12, overlap, tokens)
        assert all(overlap <= tokens.between(c, b) < 12 for (_, b), (c, _) in zip(chunks, chunks[1:], strict=False))
        assert chunks[0][0] == 0 and chunks[-1][1] == len(TEXT)


def test_floors_join_whole_chunks_only():
    t = Tokens("a b c d e")
    assert floored([(0, 2), (2, 9)], ["x", "y"], 2, t) == ([(0, 9)], ["x+y"])
    assert floored([(0, 2), (2, 9)], [None, None], 2, t, [True, False]) == ([(0, 2), (2, 9)], [None, None])
    assert fixed("a b c d e", 4, 0, 2) == [(0, 9)] and fixed("a b c d e", 4, 0, 0) == [(0, 7), (8, 9)]
    assert sentence("One. Two three four five.", 4, 0, 2)[-1][1] == 25


def test_structure_respects_units():
    assert structure("a b\nc d e f\n", [(0, 4, "x"), (4, 12, "y")], 9, 0, 3) == ([(0, 12)], ["x+y"])
    spans, labels = structure(TEXT, [(0, len(TEXT), "long")], 12, 3, 5)
    assert len(spans) > 1 and set(labels) == {"long"}
    with pytest.raises(ValueError):
        structure("a", [], 1, 0, 2)


def test_outside_chunks_get_offsets_without_overlap(spark):
    assert derive_offsets("abcdef", ["abc", "def", "abc", "", "xyz"]) == [(0, 3, "found"), (3, 6, "found"), (-1, -1, "out_of_order"), (-1, -1, "empty"), (-1, -1, "not_verbatim")]
    assert derive_offsets("aaaa", ["aaa", "aa"])[1][2] == "out_of_order"
    docs = spark.createDataFrame([(1, "abcdef"), (2, None)], "doc_id long, text string")
    pieces = spark.createDataFrame([(1, 1, "def"), (1, 0, "abc"), (2, 0, "x")], "doc_id long, idx int, piece string")
    assert sorted(map(tuple, chunking.located(pieces, docs).collect())) == [(1, 0, 0, 3, "found"), (1, 1, 3, 6, "found"), (2, 0, -1, -1, "not_verbatim")]


def test_chunks_are_their_documents(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, " "), (4, "é ü x"), (5, "no units")], "doc_id long, text string")
    units = spark.createDataFrame([(1, 0, 43, "a"), (1, 43, len(TEXT), "b"), (4, 0, 5, "c")], "doc_id long, start int, end int, kind string")
    for strategy, params in (("fixed", {"size": 8, "overlap": 2, "min_final": 3}), ("sentence", {"max_size": 8, "overlap": 2, "min_final": 3}), ("structure", {"max_size": 8, "overlap": 2, "min_size": 3})):
        got = chunking.chunked(docs, strategy, units, **params)
        both = got.join(docs.withColumnRenamed("text", "whole"), "doc_id")
        assert both.where(F.col("text") != F.expr("substring(whole, start + 1, end - start)")).count() == 0
        assert {r.doc_id for r in got.collect()} == ({1, 4} if strategy == "structure" else {1, 4, 5})
    assert {r.doc_id for r in chunking.unmarked(docs, units).collect()} == {2, 3, 5}
    for bad in (("fixed", {"size": 3}), ("odd", {}), ("structure", {"max_size": 1, "overlap": 0, "min_size": 1})):
        with pytest.raises(ValueError):
            chunking.chunked(docs, bad[0], **bad[1])


def test_homes_are_centred_in_tokens(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 27, "long-word-that-is-one x y z"), (1, 1, 22, 37, "x y z a b c d e")], "doc_id long, idx int, start int, end int, text string")
    anchors = spark.createDataFrame([(1, 22, 27), (1, 35, 60)], "doc_id long, start int, end int")
    got = {r.start: (r.home, r.depth, r.holders) for r in chunking.home_chunks(anchors, chunks).collect()}
    assert got == {22: (0, 0, 2), 35: (None, None, 0)}


def test_alignment_counts_both_edges_and_needs_units(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 10), (1, 15), (2, 0)], "doc_id long, start int")
    units = spark.createDataFrame([(1, 0, 10, "a")], "doc_id long, start int, end int, kind string")
    r = chunking.alignment(chunks, units).first()
    assert (r.starts, r.aligned, r.edges) == (3, 2, 2) and r.share == pytest.approx(2 / 3) and r.ceiling == pytest.approx(1 / 3)
    none = chunking.alignment(chunks, units.limit(0)).first()
    assert (none.outcome, none.share) == ("couldnt_check", None)


def test_near_duplicates_match_plain_jaccard(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, " ".join(base[:-4])), (3, " ".join(base[20:])), (4, "a b"), (5, None), (6, ""), (7, " ".join(reversed(base)))]
    found = duplicates.sets(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    of = duplicates.classes(found)
    scored = duplicates.scored(duplicates.candidates(of), of)
    sets = {i: {tuple((t or "").lower().split()[k : k + 5]) for k in range(len((t or "").split()) - 4)} for i, t in texts}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j and sets[i] and sets[j]}
    got = {(r.a, r.b): r.jaccard for r in duplicates.expanded(found, scored, "doc_id", 0.7).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.7}
    for r in duplicates.rates(scored, of, len(texts), (0.7, 0.9)).collect():
        near = [k for k, v in want.items() if v >= r.threshold]
        assert (r.pairs, r.documents) == (len(near), len({i for k in near for i in k}))


FILING = "<html><body>" + "".join(f"<p>Item {i}. {t}</p><p>{'words of prose ' * 400}</p>" for i, t in (("1", "Business"), ("1A", "Risk"), ("2", "Properties"), ("3", "Legal"), ("7", "Discussion"), ("8", "Statements"))) + "</body></html>"


def test_filings_are_taken_or_rejected(spark):
    assert filings.verdict(FILING)[0] is None
    assert [s[0] for s in filings.verdict(FILING)[2]] == ["1", "1A", "2", "3", "7", "8"]
    assert filings.verdict("plain")[0] == "not_html" and filings.verdict(None)[0] == "not_html" and filings.verdict("<p>short</p>")[0] == "too_short"
    assert filings.verdict("<p>" + "words " * 5000 + "</p>")[0] == "no_sections"
    assert filings.verdict(FILING.replace("Item 8.", "Thing 8."))[0] == "too_few_sections"
    empty = FILING.replace("words of prose " * 400, "Omitted.") + "<p>" + "words " * 5000 + "</p>"
    assert filings.verdict(empty.replace("<html>", "<html>" + "<p>" + "front " * 5000 + "</p>"))[0] == "sections_empty"
    rows = filings.filings(spark.createDataFrame([(1, FILING), (2, None)], "page_id long, html string"), "page_id", "html").collect()
    assert [(r.page_id, r.outcome) for r in rows] == [(1, "accepted"), (2, "rejected")]
    found = filings.section_table(spark.createDataFrame([(1, filings.filing_text(FILING))], "doc_id long, text string"), "doc_id", "text")
    assert {r.item: r.documents for r in filings.item_coverage(found).collect()}["7"] == 1


def test_contents_and_references_are_no_sections():
    toc = "\n".join(f"Item {i}. X {i}" for i in ("1", "1A", "2", "3", "4", "5", "7"))
    body = "\nItem 1. Business\n" + "a " * 3000 + "\nItem 7 of this report\nItem 7. Discussion\n" + "b " * 3000
    assert [(s[0], s[1]) for s in filings.sections(toc + body)] == [("1", "Business"), ("7", "Discussion")]
    assert filings.longest_rising([5, 1, 2, 9, 3]) == [1, 2, 4] and filings.longest_rising([]) == []


def test_tables_of_numbers_go():
    assert filings.filing_text("<p>x</p><table><tr><td>1</td><td>$2</td></tr></table><p>y</p>") == "x\n\ny"
    assert "a | b c" in filings.filing_text("<table><tr><td>a</td><td>b&nbsp;c</td></tr></table>")
    assert filings.filing_text("<div style='x' style=\"display: none\">secret</div>seen<!-- no -->") == "seen"


def test_readers_refuse_what_does_not_fit(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps(["a", "b"]))
    (tmp_path / "ids.txt").write_text("a\nb\n\nc\n")
    assert [r.id for r in loaders.ids(spark, str(tmp_path / "ids.json"), 2).orderBy("pos").collect()] == ["a", "b"]
    assert [r.id for r in loaders.ids(spark, str(tmp_path / "ids.txt"), 3).orderBy("pos").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        loaders.ids(spark, str(tmp_path / "ids.txt"), 2)
    spark.createDataFrame([(1, 0.5, 1.0), (2, 0.1, float("nan"))], "vec_id long, x double, y double").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        loaders.projection(spark, str(tmp_path / "p"), 2)
    assert loaders.metadata(spark, str(tmp_path / "p"), 2).count() == 2
    with pytest.raises(ValueError):
        loaders.metadata(spark, str(tmp_path / "p"), 3)
    with pytest.raises(ValueError):
        loaders.records(spark, str(tmp_path), ["vec_id", "odd"])
    (tmp_path / "t.jsonl").write_text('{"id": 1, "text": "x"}\n{"id": 2}\n')
    with pytest.raises(Exception, match="no text"):
        loaders.texts(spark, str(tmp_path / "t.jsonl")).collect()
    (tmp_path / "q.jsonl").write_text('{"id": "1", "vector": [1.0, 2.0]}\n')
    assert loaders.read(spark, "queries", str(tmp_path / "q.jsonl")).first().embedding == [1.0, 2.0]
    (tmp_path / "r.jsonl").write_text('{"id": "1", "abstract": "' + "a" * 300 + '", "categories": "cs.IR math", "update_date": "2020-01-02"}\n{"id": "2", "abstract": "This paper has been withdrawn ' + "a" * 300 + '", "categories": "x", "update_date": "2020"}\n{"id": "3", "abstract": "' + "a" * 300 + '", "categories": "x", "update_date": "soon"}\n')
    rows = sampling.eligible_records(loaders.categorized(spark, str(tmp_path / "r.jsonl"))).collect()
    assert [(r.id, r.primary, r.year) for r in rows] == [("1", "cs.IR", 2020)]
    with pytest.raises(ValueError):
        loaders.read(spark, "odd", "x")


def test_arrays_and_digests(spark, tmp_path):
    import hashlib

    import numpy as np

    np.save(tmp_path / "x.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [list(r.embedding) for r in loaders.vectors(spark, str(tmp_path / "x.npy")).orderBy("vec_id").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b").write_bytes(b"2")
    (tmp_path / "d" / "a").write_bytes(b"1")
    files = loaders.file_digests(spark, str(tmp_path / "d"))
    lines = [r.line for r in loaders.manifest(files).collect()]
    assert lines == [f"{hashlib.sha256(c).hexdigest()}  {n}" for n, c in (("a", b"1"), ("b", b"2"))]
    assert loaders.manifest_digest(files).first().digest == hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    assert loaders.stable_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_bridge_round_trip(spark, tmp_path):
    base = spark.createDataFrame([(i, [float(i) / 3, 1.0]) for i in range(10)], "vec_id long, embedding array<float>")
    asked = base.where("vec_id < 2").withColumnRenamed("vec_id", "query_id")
    truth = spark.createDataFrame([(0, 5, 2), (0, 4, 1), (1, 9, 1), (1, 8, 3)], "query_id long, vec_id long, rank int")
    bridge.export(base, asked, truth, str(tmp_path / "out"), shards=3, k=2)
    train = {r.id: r.emb for r in spark.read.parquet(str(tmp_path / "out" / "train")).collect()}
    assert train == {r.vec_id: r.embedding for r in base.collect()}
    assert {r.id: r.neighbors_id for r in spark.read.parquet(str(tmp_path / "out" / "neighbors")).collect()} == {0: [4, 5], 1: [9]}
    with pytest.raises(Exception, match="exist"):
        bridge.export(base, asked, truth, str(tmp_path / "out"), shards=3, k=2)
    sizes = sorted(r["count"] for r in bridge.train_shards(base, "vec_id", 3).groupBy("shard").count().collect())
    assert sizes == [3, 3, 4]
    subset = bridge.query_subset(base, "vec_id", 4, 1)
    digest = bridge.write_subset(subset, "vec_id", str(tmp_path / "s.json"), 1)
    assert len(digest) == 64 and len(json.loads((tmp_path / "s.json").read_text())["ids"]) == 4
    with pytest.raises(FileExistsError):
        bridge.write_subset(subset, "vec_id", str(tmp_path / "s.json"), 1)
    for size in (0, 11):
        with pytest.raises(ValueError):
            bridge.query_subset(base, "vec_id", size, 1)
    (tmp_path / "r.json").write_text(json.dumps({"run_id": "r", "results": [{"label": ":)", "task_config": {"db": "e", "db_config": {"version": "1"}}, "metrics": {"qps": 5.0, "odd": 1}}, {"label": "?", "task_config": {"db": "f"}, "metrics": {"qps": 1.0}}]}))
    rows = bridge.cases(spark, str(tmp_path / "r.json")).collect()
    assert [(r.engine, r.outcome, r.qps) for r in rows] == [("e", "measured", 5.0), ("f", "couldnt_check", None)]


@pytest.mark.parametrize("ids", [[i * 7919 % 20011 for i in range(20011)], [None] * 7 + [5] * 11 + list(range(6)), [None] * 9, [3] * 10, [4, None], []], ids=["many", "ties", "nulls", "one id", "few", "none"])
def test_train_shards_are_ntiles(spark, ids):
    """More ids than bounds of ranges are drawn from; ids held by several shards, and none, which come last."""
    rows = [(i, f"{n * 7 % 100:02d}") for n, i in enumerate(ids)]
    base = spark.createDataFrame(rows, "vec_id long, other string").repartition(2)
    whole, more = divmod(len(ids), 4)
    names = [f"train-{s:02d}-of-04" for s in range(4) for _ in range(whole + (s < more))]
    want = Counter((*row, name) for row, name in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), names, strict=True))
    out = bridge.train_shards(base, "vec_id", 4)
    assert out.columns == ["vec_id", "other", "shard"]
    assert Counter(map(tuple, out.collect())) == want


def test_published_points_are_read_from_a_page(spark):
    page = " ".join(f"M=12, efConstruction=500: ef={ef}, recall={r}" for ef, r in ((10, 0.3), (20, 0.5), (40, 0.7))) + " M=16, efConstruction=500: ef=10, recall=0.4"
    points = bridge.published_points(spark.createDataFrame([(page,)], "html string"))
    assert sorted((r.m, r.ef, r.recall) for r in bridge.complete_sweeps(points, [10, 20, 40]).collect()) == [(12, 10, 0.3), (12, 20, 0.5), (12, 40, 0.7)]


def test_samples(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", f"2020-{i % 12 + 1:02d}") for i in range(60)], "id long, s string, at string")
    assert {r.s: r["count"] for r in sampling.stratified(df, "s", 9, 1, "id").groupBy("s").count().collect()} == {"s0": 3, "s1": 3, "s2": 3}
    with pytest.raises(ValueError):
        sampling.reservoir(df, "s", 2, 1, "id", quota=3)
    assert sampling.rows_of(df, "id", "at", 5).count() == 5
    assert sampling.before_cutoff(df, "at").where("before").count() == 30
    assert loaders.clean_markup(F.lit("x")) is not None
    cleaned = spark.createDataFrame([("a ```code\nx``` `b` [c](http://d)\n    indented\n<i>e</i>  f",), (None,)], "t string").select(loaders.clean_markup(F.col("t")).alias("t")).collect()
    assert [r.t for r in cleaned] == ["a b c e f", ""]


def test_bundles_need_an_extraction(spark):
    for bad in ((None,), ("tool",), ("unknown",)):
        with pytest.raises(ValueError):
            chunking.declared_extraction(*bad)
    made = chunking.declared_extraction("tool", "1.2")
    docs = spark.createDataFrame([(1, "This is one two three. Four five."), (2, "Six seven.")], "doc_id long, text string")
    chunks = chunking.chunked(docs, "fixed", size=3, overlap=0, min_final=0)
    spans = spark.createDataFrame([(1, 0, 7, "s"), (1, 5, 30, "t")], "doc_id long, start int, end int, kind string")
    rows = {r.measure: (r.value, r.outcome) for r in chunking.bundle(chunks, extraction=made, spans=spans, floor=2, cap=3).collect()}
    assert rows["span_survival"] == (0.5, "measured") and rows["boundary_alignment"] == (None, "couldnt_check") and rows["orphans"][0] == 1.0
    assert rows["unresolved_references"][0] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        chunking.bundle(chunks, extraction={})
