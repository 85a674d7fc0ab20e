"""Queries of readers and cleaners over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators.vectors import usable
from cairn.plans.registry import Literal, query, table
from cairn.sources import bridge, filings, loaders


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dim FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
def vector_scan(spark, sf):
    df = usable(loaders.vectors(spark, f"{sf}/embeddings.parquet", "vec_id"))
    return df.select("vec_id", F.size("embedding").alias("dim"))


@query("""WITH e AS (SELECT sha256(CAST(doc_id AS VARCHAR) || '|' || coalesce(text, '')) AS d, count(*) AS n FROM documents GROUP BY 1),
g AS (SELECT substr(d, 1, 2) AS g, sha256(string_agg(d || ':' || n, chr(10) ORDER BY d || ':' || n)) AS h FROM e GROUP BY 1)
SELECT sha256(string_agg(g || ':' || h, chr(10) ORDER BY g)) AS digest FROM g""")
def manifest_digest(spark, sf):
    return loaders.digest(table(spark, sf, "documents"), F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))


@query("SELECT vec_id, 'train-0' || CAST(ntile(4) OVER (ORDER BY vec_id) - 1 AS VARCHAR) || '-of-04' AS shard FROM embeddings")
def benchmark_shards(spark, sf):
    return bridge.train_shards(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 4)


@query("SELECT vec_id FROM embeddings ORDER BY md5('9:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 50")
def seeded_query_subset(spark, sf):
    return bridge.query_subset(table(spark, sf, "embeddings"), "vec_id", 50, 9)


CLEANED = "coalesce(text, '')"
for rule, by, flags in (("```.*?```", " ", "gs"), ("^( {4}|\t).*$", " ", "gm"), ("\\[([^\\]]*)\\]\\([^)]*\\)", "\\1", "g"), ("<[^>]+>", " ", "g"), ("`", "", "g"), ("\\s+", " ", "g")):
    CLEANED = f"regexp_replace({CLEANED}, '{rule}', '{by}', '{flags}')"


@query(f"SELECT doc_id, trim({CLEANED}) AS body FROM documents")
def clean_bodies(spark, sf):
    return table(spark, sf, "documents").select("doc_id", loaders.clean_markup(F.col("text")).alias("body"))


SEEN = "html"
for rule, by in (("(?is)<script\\b.*?</script\\s*>", " "), ("(?is)<style\\b.*?</style\\s*>", " "), ("(?is)<!--.*?-->", " "), ("(?is)<br\\s*/?>|</(p|div|li|tr|h[1-6])\\s*>", "\n"), ("(?s)<[^>]*>", " ")):
    SEEN = f"regexp_replace({SEEN}, '{rule}', '{by}', 'g')"
for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    SEEN = f"replace({SEEN}, '{entity}', '{plain}')"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace({SEEN}, '[ \t]+', ' ', 'g'), '\\s*\n\\s*', '\n', 'g')) AS body FROM pages")
def page_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", loaders.visible_text(F.col("html")).alias("body"))


@query("SELECT doc_id AS id, text AS body, lang AS category FROM documents")
def field_map(spark, sf):
    return loaders.renamed(table(spark, sf, "documents"), {"id": "doc_id", "body": "text", "category": "lang"}).select("id", "body", "category")


@query("SELECT o_orderkey, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INT) AS year, split_part(trim(o_orderpriority), ' ', 1) AS category FROM orders")
def years_and_categories(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", loaders.year_of(F.col("o_orderdate")).alias("year"), loaders.primary_category(F.col("o_orderpriority")).alias("category"))


DIGESTS = Literal("there", "name VARCHAR, sha256 VARCHAR", [("a", "1"), ("b", "2"), ("c", "3")])
PINS = Literal("pins", "name VARCHAR, sha256 VARCHAR", [("a", "1"), ("b", "9"), ("d", "4")])


@query(f"WITH {DIGESTS.sql()}, {PINS.sql()} SELECT coalesce(t.name, p.name) AS name, CASE WHEN p.name IS NULL THEN 'unpinned' WHEN t.name IS NULL THEN 'absent' WHEN t.sha256 = p.sha256 THEN 'verified' ELSE 'contradicted' END AS outcome FROM there t FULL JOIN pins p ON p.name = t.name")
def pinned_digests(spark, sf):
    return loaders.pinned(DIGESTS.frame(spark), PINS.frame(spark))


def headed(spark, sf):
    """Documents three times over, each time under a numbered heading."""
    parts = [x for title in ("Item 1. Business", "Item 1A. Risk Factors", "Item 7. Discussion") for x in (F.lit(f"{title}\n"), F.col("text"), F.lit("\n"))]
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(*parts).alias("text"))


SECTIONS = """l AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL),
sec AS (SELECT doc_id, '1' AS item, 0 AS start, 17 + n + 1 AS "end" FROM l UNION ALL SELECT doc_id, '1A', 18 + n, 18 + n + 22 + n + 1 FROM l UNION ALL SELECT doc_id, '7', 41 + 2 * n, 41 + 2 * n + 19 + n + 1 FROM l)"""


@query(f'WITH {SECTIONS} SELECT doc_id, item, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM sec')
def numbered_sections(spark, sf):
    return filings.section_table(headed(spark, sf), "doc_id", "text").select("doc_id", "item", "start", "end")


@query(f"""WITH {SECTIONS} SELECT (SELECT count(*) FROM l) AS documents, 3::BIGINT AS sections_p50, 3::BIGINT AS sections_p95, 3::BIGINT AS sections_most, 3.0::DOUBLE AS sections_mean, count(*) AS sections,
CAST(floor(quantile_cont("end" - start, 0.05)) AS BIGINT) AS chars_p5, CAST(floor(quantile_cont("end" - start, 0.5)) AS BIGINT) AS chars_p50, CAST(floor(quantile_cont("end" - start, 0.95)) AS BIGINT) AS chars_p95, CAST(max("end" - start) AS BIGINT) AS chars_most FROM sec""")
def section_statistics(spark, sf):
    docs = headed(spark, sf)
    out = filings.section_statistics(docs, filings.section_table(docs, "doc_id", "text"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("sections_p50", "sections_p95", "sections_most", "chars_p5", "chars_p50", "chars_p95", "chars_most")})


@query()
def filing_verdicts(spark, sf):
    return filings.filings(table(spark, sf, "pages"), "page_id", "html").select("page_id", "outcome", "reason")


CASES = Literal("c", "run_id VARCHAR, db VARCHAR, label VARCHAR, qps DOUBLE, recall DOUBLE", [("r", "e1", ":)", 100.0, 0.9), ("r", "e2", "?", 7.0, 0.1), ("r", "e3", "x", None, None), ("r", "e4", "odd", 1.0, 1.0)])


@query(f"WITH {CASES.sql()} SELECT db AS engine, CASE WHEN label = ':)' THEN 'measured' ELSE 'couldnt_check' END AS outcome, CASE label WHEN ':)' THEN NULL WHEN '?' THEN 'a stage ran out of time' WHEN 'x' THEN 'the case failed' ELSE 'an unknown label' END AS reason, CASE WHEN label = ':)' THEN qps END AS qps FROM c")
def benchmark_cases(spark, sf):
    rows = CASES.frame(spark)
    figures = F.struct(*((F.col(f) if f in rows.columns else F.lit(None).cast("double")).alias(f) for f in bridge.FIGURES))
    case = F.struct("label", F.struct("db", F.struct(F.lit(None).cast("string").alias("version")).alias("db_config")).alias("task_config"), figures.alias("metrics"))
    return bridge.imported(rows.select("run_id", case.alias("c"))).select("engine", "outcome", "reason", "qps")


POINTS = Literal("p", "m BIGINT, ef_construction BIGINT, recall DOUBLE", [(12, 500, 0.3), (12, 500, 0.5), (12, 500, 0.4), (16, 500, 0.6), (16, 500, 0.6)])


@query(f"WITH {POINTS.sql()}, l AS (SELECT m, ef_construction, list_sort(list(DISTINCT recall)) AS r FROM p GROUP BY ALL) SELECT m, ef_construction, CAST([10, 20, 40][i] AS INT) AS ef, r[i] AS recall FROM l, (SELECT unnest([1, 2, 3]) AS i) WHERE len(r) = 3")
def published_sweeps(spark, sf):
    return bridge.complete_sweeps(POINTS.frame(spark), [10, 20, 40])
