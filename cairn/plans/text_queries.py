"""Queries over `documents`, `events` and other tables: samples, duplicates, chunks, latencies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import chunking, duplicates, metrics, sampling
from cairn.plans.registry import Literal, query, table

MD5 = "md5('{seed}:' || CAST({id} AS VARCHAR))"
WORDS = "[w FOR w IN regexp_split_to_array(coalesce(text, ''), '\\s+') IF w <> '']"
LOWER = "[w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '\\s+') IF w <> '']"


@query(f"SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY {MD5.format(seed=7, id='c_custkey')}, c_custkey LIMIT 100)")
def uniform_subsample(spark, sf):
    return sampling.subsample(table(spark, sf, "customer"), 100, 7, "c_custkey").select("c_custkey")


QUOTA = """c AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang), r AS (SELECT lang, c, 200 * c / sum(c) OVER () AS raw FROM c),
f AS (SELECT *, floor(raw) AS whole, 200 - sum(floor(raw)) OVER () AS rest FROM r),
quota AS (SELECT lang, c, CAST(whole + CASE WHEN row_number() OVER (ORDER BY raw - whole DESC, lang) <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"""


@query(f"WITH {QUOTA} SELECT lang, c AS count, quota FROM quota")
def largest_remainder_quotas(spark, sf):
    return sampling.quotas(table(spark, sf, "documents"), "lang", 200)


@query(f"WITH {QUOTA}, i AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format(seed=3, id='doc_id')}, doc_id) AS i FROM documents) SELECT doc_id, lang FROM i JOIN quota USING (lang) WHERE i <= quota")
def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 200, 3, "doc_id").select("doc_id", "lang")


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {MD5.format(seed=1, id='doc_id')}, doc_id) AS i FROM documents) WHERE i <= 5")
def reservoir_by_source(spark, sf):
    return sampling.reservoir(table(spark, sf, "documents").select("doc_id", "source"), "source", 5, 1, "doc_id")


HOT = "top AS (SELECT c_nationkey FROM (SELECT c_nationkey, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS i, count(*) OVER () AS n FROM customer GROUP BY c_nationkey) WHERE i <= greatest(1, floor(n * 0.05)))"


@query(f"""WITH {HOT}, q AS ((SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM top) ORDER BY {MD5.format(seed=5, id='c_custkey')}, c_custkey LIMIT 20)
UNION ALL (SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT * FROM top) ORDER BY {MD5.format(seed=5, id='c_custkey')}, c_custkey LIMIT 20))
SELECT c_custkey, c_custkey IN (SELECT * FROM q) AS asked FROM customer""")
def hot_query_split(spark, sf):
    queries, base = sampling.split_queries(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 40, 5, "c_custkey")
    return queries.select("c_custkey", F.lit(True).alias("asked")).unionByName(base.select("c_custkey", F.lit(False).alias("asked")))


@query("WITH m AS (SELECT list_sort(list(CAST(o_orderdate AS VARCHAR)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS t FROM orders) SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) < t AS before FROM orders, m")
def train_before_cutoff(spark, sf):
    return sampling.before_cutoff(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "before")


@query(f"SELECT count(*) AS texts, CAST(count(*) FILTER (n > 256) AS BIGINT) AS truncated, avg(CASE WHEN n > 256 THEN 1.0 ELSE 0.0 END) AS fraction, max(n) AS longest FROM (SELECT len({WORDS}) AS n FROM documents)")
def model_truncation(spark, sf):
    return sampling.truncated(table(spark, sf, "documents"), "text", 256)


@query("SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) >= 200 AND source IS NOT NULL AND trim(source) <> ''")
def eligible_documents(spark, sf):
    return sampling.eligible(table(spark, sf, "documents"), "text", 200, ("source",)).select("doc_id")


SHINGLES = f"sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {LOWER} AS w FROM documents) WHERE len(w) >= 5))"


@query(f"WITH {SHINGLES} SELECT d.doc_id, count(s) AS shingles FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id")
def shingle_sets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(duplicates.shingles(F.col("text"))).cast("long").alias("shingles"))


def similar(spark, sf):
    found = duplicates.sets(table(spark, sf, "documents"), "doc_id", "text")
    of = duplicates.classes(found)
    return found, of, duplicates.scored(duplicates.candidates(of), of)


JACCARD = f"{SHINGLES}, n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL), j AS MATERIALIZED (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b)"


@query(f"WITH {JACCARD} SELECT a, b, round(jaccard, 9) AS jaccard FROM j WHERE jaccard >= 0.8")
def near_duplicate_pairs(spark, sf):
    found, _, scored = similar(spark, sf)
    return duplicates.expanded(found, scored, "doc_id", 0.8).withColumn("jaccard", F.round("jaccard", 9))


RATES = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, (SELECT count(*) FROM j WHERE jaccard >= {t}) AS pairs, (SELECT count(DISTINCT d) FROM (SELECT unnest([a, b]) AS d FROM j WHERE jaccard >= {t})) AS documents, 'exact' AS kind" for t in (0.7, 0.8, 0.9))


@query(f"WITH {JACCARD}, r AS ({RATES}) SELECT threshold, pairs, documents, round(documents / (SELECT count(*) FROM documents), 9) AS rate, kind FROM r")
def near_duplicate_rates(spark, sf):
    """At the thresholds that banding all but never misses."""
    _, of, scored = similar(spark, sf)
    return duplicates.rates(scored, of, table(spark, sf, "documents").count(), (0.7, 0.8, 0.9)).withColumn("rate", F.round("rate", 9))


@query()
def near_duplicate_lower_bounds(spark, sf):
    _, of, scored = similar(spark, sf)
    return duplicates.rates(scored, of, table(spark, sf, "documents").count(), (0.5, 0.6))


@query(" UNION ALL ".join(f"SELECT CAST({s / 10} AS DOUBLE) AS similarity, round(1 - pow(1 - pow({s / 10}, 4), 32), 9) AS recall" for s in range(11)))
def banding_recall(spark, sf):
    return spark.createDataFrame([(s / 10, round(duplicates.lsh_recall(s / 10), 9)) for s in range(11)], "similarity double, recall double")


@query(f"""WITH n AS (SELECT doc_id, len({WORDS}) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n > 512 THEN CAST(ceil((n - 512) / 448.0) AS BIGINT) ELSE 0 END + 1)) AS idx FROM n WHERE n > 0)
SELECT doc_id, CAST(idx AS INT) AS idx, CAST(idx * 448 AS INT) AS first, CAST(least(512, n - idx * 448) AS INT) AS tokens FROM w WHERE idx = 0 OR n - idx * 448 >= 32""")
def fixed_windows(spark, sf):
    return chunking.fixed_windows(table(spark, sf, "documents"), 512, 64, 32)


SIZE, OVERLAP, LEAST = 128, 16, 32


def chunks_of(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"), "fixed", size=SIZE, overlap=OVERLAP, min_final=LEAST)


def sentences_of(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"), "sentence", max_size=SIZE, overlap=OVERLAP, min_final=LEAST)


TOKENS = """raw AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '\\s*\\S+') AS p FROM documents),
piece AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM raw),
tok AS MATERIALIZED (SELECT doc_id, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(regexp_replace(p, '^\\s+', '')) AS l FROM piece)"""
CHUNKS = f"""{TOKENS}, cnt AS (SELECT doc_id, text, len(p) AS n FROM raw WHERE len(p) > 0),
win AS (SELECT doc_id, text, n, idx, idx * {SIZE - OVERLAP} AS lo, least(idx * {SIZE - OVERLAP} + {SIZE}, n) AS hi, count(*) OVER (PARTITION BY doc_id) AS k
  FROM (SELECT doc_id, text, n, unnest(range(0, CASE WHEN n > {SIZE} THEN CAST(ceil((n - {SIZE}) / {SIZE - OVERLAP}.0) AS BIGINT) ELSE 0 END + 1)) AS idx FROM cnt)),
kept AS (SELECT doc_id, text, idx, lo, CASE WHEN k > 1 AND idx = k - 2 AND n - (k - 1) * {SIZE - OVERLAP} < {LEAST} THEN n ELSE hi END AS hi FROM win WHERE NOT (k > 1 AND idx = k - 1 AND hi - lo < {LEAST})),
chunk AS MATERIALIZED (SELECT kept.doc_id, CAST(idx AS INT) AS idx, CAST(a.e - a.l AS INT) AS s, CAST(b.e AS INT) AS e, CAST(hi - lo AS INT) AS tokens, substring(text, CAST(a.e - a.l + 1 AS BIGINT), CAST(b.e - a.e + a.l AS BIGINT)) AS text
  FROM kept JOIN tok a ON a.doc_id = kept.doc_id AND a.i = lo + 1 JOIN tok b ON b.doc_id = kept.doc_id AND b.i = hi)"""
LINES = """parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
line AS MATERIALIZED (SELECT doc_id, CAST(coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s, length(p) AS l, p FROM parts),
lines AS MATERIALIZED (SELECT doc_id, s, CAST(s + l AS INT) AS e, p FROM line WHERE l > 0)"""


@query(f'WITH {CHUNKS} SELECT doc_id, idx, s AS start, e AS "end", tokens, text FROM chunk')
def chunks_fixed(spark, sf):
    return chunks_of(spark, sf).drop("unit")


@query()
def chunks_sentence(spark, sf):
    return sentences_of(spark, sf)


@query()
def chunks_structure(spark, sf):
    docs = table(spark, sf, "documents")
    return chunking.chunked(docs, "structure", lines_of(spark, sf).withColumn("kind", F.lit("line")), max_size=256, overlap=0, min_size=32)


def lines_of(spark, sf):
    """(doc_id, start, end, text) of lines, as sections and as spans."""
    parts = F.split(F.col("text"), "\n")
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(parts).alias("i", "p"))
    start = F.coalesce(F.sum(F.length("p") + 1).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.select("doc_id", start.alias("start"), (start + F.length("p")).cast("int").alias("end"), F.col("p").alias("text")).where("end > start")


@query(f"""WITH {CHUNKS}, {LINES}, sp AS (SELECT DISTINCT doc_id, s, e, CASE WHEN e - s < 200 THEN 'short' ELSE 'long' END AS kind FROM lines),
held AS (SELECT sp.doc_id, sp.s, sp.e, sp.kind, bool_or(c.idx IS NOT NULL) AS ok FROM sp LEFT JOIN chunk c ON c.doc_id = sp.doc_id AND c.s <= sp.s AND c.e >= sp.e GROUP BY ALL)
SELECT kind, count(*) AS spans, CAST(count(*) FILTER (ok) AS BIGINT) AS survived, round(count(*) FILTER (ok) / count(*), 9) AS share FROM held GROUP BY ROLLUP (kind)""")
def span_survival(spark, sf):
    spans = lines_of(spark, sf).drop("text").withColumn("kind", F.when(F.col("end") - F.col("start") < 200, "short").otherwise("long"))
    return chunking.survival(spans.distinct(), chunks_of(spark, sf)).withColumn("share", F.round("share", 9))


@query(f"WITH {CHUNKS}, {LINES}, x AS (SELECT c.doc_id, c.idx, count(l.s) AS n FROM chunk c LEFT JOIN lines l ON l.doc_id = c.doc_id AND l.s < c.e AND l.e > c.s GROUP BY ALL) SELECT count(*) AS chunks, CAST(count(*) FILTER (n > 1) AS BIGINT) AS crossing FROM x")
def section_crossing(spark, sf):
    out = chunking.crossing(chunks_of(spark, sf), lines_of(spark, sf))
    return out.agg(F.count("*").alias("chunks"), F.sum(F.col("crosses").cast("long")).alias("crossing"))


@query(f"""WITH {CHUNKS}, {LINES}, edge AS (SELECT DISTINCT doc_id, unnest([s, e]) AS at FROM lines), c AS (SELECT * FROM chunk WHERE doc_id IN (SELECT doc_id FROM lines))
SELECT (SELECT count(*) FROM c) AS starts, (SELECT count(*) FROM c JOIN edge ON edge.doc_id = c.doc_id AND edge.at = c.s) AS aligned, round((SELECT count(*) FROM c JOIN edge ON edge.doc_id = c.doc_id AND edge.at = c.s) / (SELECT count(*) FROM c), 9) AS share, round((SELECT count(*) FROM lines) / (SELECT count(*) FROM c), 9) AS ceiling, (SELECT count(*) FROM edge) AS edges, 'measured' AS outcome""")
def boundary_alignment(spark, sf):
    return chunking.alignment(chunks_of(spark, sf), lines_of(spark, sf)).withColumns({c: F.round(c, 9) for c in ("share", "ceiling")})


@query(f"""WITH {CHUNKS} SELECT count(*) AS chunks, CAST(floor(quantile_cont(tokens, 0.05)) AS BIGINT) AS p5, CAST(floor(quantile_cont(tokens, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(tokens, 0.95)) AS BIGINT) AS p95, min(tokens) AS least, max(tokens) AS most,
round(avg(tokens), 2) AS mean, CAST(count(*) FILTER (tokens < {LEAST}) AS BIGINT) AS orphans, CAST(count(*) FILTER (tokens >= {SIZE}) AS BIGINT) AS at_cap FROM chunk""")
def chunk_lengths(spark, sf):
    return chunking.lengths(chunks_of(spark, sf), LEAST, SIZE)


REFERS = "regexp_matches(text, '(?i)^\\W*(this|that|these|those|it|its|they|them|their|such|the\\s+above|the\\s+foregoing|the\\s+former|the\\s+latter|he|she|his|her)(\\W|$)')"


def pieces(spark, sf):
    """English texts as chunks of words."""
    return table(spark, sf, "documents").where("lang = 'en'").select(F.col("text"))


@query(f"SELECT count(*) AS chunks, CAST(count(*) FILTER ({REFERS}) AS BIGINT) AS unresolved, round(count(*) FILTER ({REFERS}) / count(*), 9) AS rate FROM documents WHERE lang = 'en'")
def unresolved_references(spark, sf):
    return chunking.unresolved(pieces(spark, sf)).select("chunks", "unresolved", F.round("rate", 9).alias("rate"))


@query(f"SELECT regexp_replace(regexp_replace(lower(regexp_extract(text, '(\\S+)', 1)), '^[.,;:]+', ''), '[.,;:]+$', '') AS opening, count(*) AS count FROM documents WHERE lang = 'en' AND {REFERS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def reference_openings(spark, sf):
    return chunking.reference_openings(pieces(spark, sf))


#: Anchors that are drawn, as the measure has it.
ANCHORS = 2000


def anchors_of(spark, sf):
    return chunking.anchors(lines_of(spark, sf), ANCHORS, 0)


ANCHOR = f"""anchor AS MATERIALIZED (SELECT doc_id, s, e, p FROM lines WHERE len(regexp_extract_all(p, '\\S+')) >= 8 ORDER BY md5('0:' || CAST(doc_id AS VARCHAR) || ':' || CAST(s AS VARCHAR)), doc_id, s LIMIT {ANCHORS}),
held AS (SELECT a.doc_id, a.s, a.e, c.idx, least(len(regexp_extract_all(substring(c.text, 1, a.s - c.s), '\\S+')), len(regexp_extract_all(substring(c.text, a.e - c.s + 1), '\\S+'))) AS depth FROM anchor a JOIN chunk c ON c.doc_id = a.doc_id AND c.s <= a.s AND c.e >= a.e),
home AS (SELECT doc_id, s, e, arg_max(idx, (depth, -idx)) AS home, max(depth) AS depth, count(*) AS holders FROM held GROUP BY ALL)"""


@query(f'WITH {CHUNKS}, {LINES}, {ANCHOR} SELECT a.doc_id, a.s AS start, a.e AS "end", home, CAST(depth AS INT) AS depth, coalesce(holders, 0) AS holders FROM anchor a LEFT JOIN home h ON h.doc_id = a.doc_id AND h.s = a.s AND h.e = a.e')
def anchor_homes(spark, sf):
    return chunking.home_chunks(anchors_of(spark, sf), chunks_of(spark, sf))


CLOSED = "[" + ", ".join(f"'{w}'" for w in chunking.FUNCTION_WORDS) + "]"
CONTENT = f"[w FOR w IN {WORDS} IF NOT list_contains({CLOSED}, regexp_replace(regexp_replace(lower(w), '^[.,;:()\"'']+', ''), '[.,;:()\"'']+$', ''))]"


@query(f"""SELECT doc_id, text AS verbatim, CASE WHEN trim(regexp_replace(text, '^[^,;:]{{1,120}}[,;:]\\s*', '')) = '' THEN text ELSE regexp_replace(text, '^[^,;:]{{1,120}}[,;:]\\s*', '') END AS drop_first_clause,
CASE WHEN len({CONTENT}) = 0 THEN text ELSE array_to_string({CONTENT}, ' ') END AS function_words_removed FROM documents""")
def perturbations(spark, sf):
    made = chunking.perturbed(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *(c.alias(name) for name, c in made.items()))


@query()
def self_retrieval(spark, sf):
    """Whether spans find the chunk they come from, by hashed bags of words in place of a model's vectors."""
    from cairn.operators import knn

    chunks = chunks_of(spark, sf).withColumn("vec_id", F.xxhash64("doc_id", "idx"))
    anchors = anchors_of(spark, sf).withColumn("query_id", F.xxhash64("doc_id", "start"))
    answers = knn.exact(chunking.bag_vectors(chunks, "vec_id", F.col("text")), chunking.bag_vectors(anchors, "query_id", F.col("text")), 5)
    found = answers.join(chunks.select("vec_id", "doc_id", "idx"), "vec_id").select("query_id", "doc_id", "idx", "rank")
    return chunking.self_retrieval(anchors, chunks, found, 5)


@query()
def chunk_duplicates(spark, sf):
    """The near-duplicate rate of chunks, and what it exceeds that of the documents by."""
    _, of, scored = similar(spark, sf)
    whole = duplicates.rates(scored, of, table(spark, sf, "documents").count(), (0.8,)).first().rate
    found = duplicates.sets(chunks_of(spark, sf).withColumn("key", F.xxhash64("doc_id", "idx")), "key", "text").cache()
    of = duplicates.classes(found)
    return chunking.duplicates_against(duplicates.rates(duplicates.scored(duplicates.candidates(of), of), of, found.count(), (0.8,)), whole)


STRATEGY = Literal("st", "strategy VARCHAR, p50 BIGINT, self_recall DOUBLE", [("a", 10, 0.9), ("b", 10, 0.2), ("c", 90, 0.9), ("d", None, 0.9)])


@query(f"WITH {STRATEGY.sql()} SELECT strategy, CASE WHEN p50 < 32 AND self_recall >= 0.8 THEN 'flagged' ELSE 'not_flagged' END AS outcome FROM st")
def fragmented_strategies(spark, sf):
    return chunking.fragmented(STRATEGY.frame(spark), 32, 0.8).select("strategy", "outcome")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def latency_shape(spark, sf):
    out = metrics.latency(table(spark, sf, "events"), "value", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99", "mean")})


RUNS = "runs AS (SELECT event_type, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type)"


@query(f"WITH {RUNS} SELECT round(min(p95), 6) AS least, round(quantile_cont(p95, 0.5), 6) AS middle, round(max(p95), 6) AS most, round(max(p95) - min(p95), 6) AS spread, count(*) AS runs FROM runs")
def p95_spread(spark, sf):
    out = metrics.spread(metrics.latency(table(spark, sf, "events"), "value", "event_type"), "p95")
    return out.withColumns({c: F.round(c, 6) for c in ("least", "middle", "most", "spread")})


@query("SELECT event_type, count(*) / 60.0 AS achieved_qps, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS error_rate, count(*) / 60.0 < 0.9 * 40 AS shortfall FROM events GROUP BY event_type")
def load_summary(spark, sf):
    return metrics.load_summary(table(spark, sf, "events"), ["event_type"], F.lit(60.0), F.col("value") > 100, 40.0)


@query(f"WITH {RUNS}, l AS (SELECT CAST(n AS DOUBLE) AS qps, p95, event_type FROM runs) SELECT round(avg(qps), 6) AS mean_qps, min(qps) AS min_qps, round(avg(p95), 6) AS mean_p95, round(max(p95), 6) AS max_p95, arg_min(event_type, qps) AS slowest_by_qps, arg_max(event_type, p95) AS slowest_by_p95, CASE WHEN count(*) < 2 THEN 'couldnt_check' ELSE 'measured' END AS outcome FROM l")
def node_fan_out(spark, sf):
    nodes = metrics.latency(table(spark, sf, "events"), "value", "event_type").select(F.col("event_type").alias("node"), F.col("n").cast("double").alias("qps"), "p95")
    return metrics.fan_out(nodes).withColumns({c: F.round(c, 6) for c in ("mean_qps", "mean_p95", "max_p95")})


NOISE = Literal("z", "engine VARCHAR, transport VARCHAR, rtt_p95 DOUBLE, query_p95 DOUBLE", [("e", "rest", 1.0, 10.0), ("e", "rest", 3.0, 10.0), ("e", "grpc", 3.0, 10.0), ("f", "tcp", 5.0, 10.0), ("f", None, 5.0, 0.0)])


@query(f"WITH {NOISE.sql()} SELECT engine, transport, CASE WHEN query_p95 > 0 THEN rtt_p95 / query_p95 END AS rtt_share, CASE WHEN query_p95 <= 0 OR rtt_p95 / query_p95 <= 0.2 THEN 'usable' WHEN engine = 'e' AND transport = 'grpc' THEN 'unanswerable_here' ELSE 'environment_noise' END AS outcome FROM z")
def round_trip_noise(spark, sf):
    return metrics.round_trip_noise(NOISE.frame(spark), {"e": "grpc"}).select("engine", "transport", "rtt_share", "outcome")


RUNGS = Literal("g", "rung BIGINT, qps DOUBLE, error_rate DOUBLE, p99 DOUBLE", [(1, 10.0, 0.0, 5.0), (2, 20.0, 0.0, 6.0), (3, 30.0, 0.2, 6.0), (4, 40.0, 0.0, 6.0)])


@query(f"WITH {RUNGS.sql()}, m AS (SELECT *, max(CASE WHEN error_rate > 0.005 OR p99 > 5 * (SELECT arg_min(p99, rung) FROM g) THEN 1 ELSE 0 END) OVER (ORDER BY rung) AS gone FROM g) SELECT max(qps) FILTER (gone = 0) AS ceiling_qps, min(rung) FILTER (gone = 1) AS degraded_at FROM m")
def qps_ladder(spark, sf):
    return metrics.ladder(RUNGS.frame(spark))


PROBES = Literal("b", "model VARCHAR, probed BIGINT, seconds DOUBLE", [("m1", 500, 2.5), ("m2", 500, 0.0), ("m3", 500, None)])


@query(f"WITH {PROBES.sql()} SELECT model, probed / nullif(seconds, 0) AS per_second, round(3600000 / (probed / nullif(seconds, 0)) / 3600, 9) AS hours, CASE WHEN probed / nullif(seconds, 0) IS NULL THEN 'couldnt_check' ELSE 'projected' END AS outcome FROM b")
def embedding_costs(spark, sf):
    return metrics.embedding_cost(PROBES.frame(spark), 3_600_000).withColumn("hours", F.round("hours", 9))
