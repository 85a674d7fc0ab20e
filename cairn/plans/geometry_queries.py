"""Queries over `embeddings`: rows whose id is divisible by 100 are the queries, all rows the base; labels are regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import engine, families, knn, measures, metrics, regions, state, views
from cairn.operators.vectors import inner, normalized, usable
from cairn.plans.registry import query, table

K, EPS = 10, 0.2


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = usable(table(spark, sf_dir, "embeddings"))
    return df.select("vec_id", "label", normalized(F.col("embedding")).alias("e"))


def asked(base: DataFrame) -> DataFrame:
    return base.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "e")


def truth(base: DataFrame, k: int = 100) -> DataFrame:
    return knn.exact(base, asked(base), k)


def labelled(base: DataFrame) -> DataFrame:
    return base.where(F.col("label").isNotNull()).withColumn("region", F.col("label").cast("long"))


def cents_of(base: DataFrame) -> DataFrame:
    return regions.centroids(labelled(base), "region")


def dist_of(base: DataFrame, t: int = 4) -> DataFrame:
    return regions.distances(labelled(base), cents_of(base), t)


def query_dist(base: DataFrame, t: int = 4) -> DataFrame:
    return regions.distances(asked(base), cents_of(base), t, id_="query_id")


def semantic(base: DataFrame, eps: float = EPS, probe: int = 2, k: int = K) -> DataFrame:
    cents = cents_of(base)
    return families.semantic_search(regions.placed(labelled(base), cents, eps), regions.distances(asked(base), cents, probe, id_="query_id"), asked(base), k)


def state_of(base: DataFrame, eps: float = EPS, probe: int = 2, depth: int = 30, k: int = K) -> state.State:
    return state.emitted(labelled(base).select("vec_id", "e"), asked(base), cents_of(base), knn.exact(labelled(base), asked(base), k), eps=eps, probe=probe, depth=depth)


V = """v AS MATERIALIZED (SELECT vec_id, label, [x / CASE WHEN n > 0 THEN n ELSE 1 END FOR x IN d] AS e
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS d, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
        FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)),
q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 100 = 0)"""
T = f"""{V}, s AS MATERIALIZED (SELECT query_id, v.vec_id, v.label, round(list_inner_product(q.e, v.e), 9) AS score FROM q, v),
truth AS MATERIALIZED (SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 100)"""
C = """cents AS MATERIALIZED (SELECT region, list(x ORDER BY i) AS c, max(size) AS size FROM
  (SELECT label AS region, i, round(avg(e[i]), 9) AS x, count(*) AS size FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM v WHERE label IS NOT NULL) GROUP BY label, i) GROUP BY region),
dist AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, region) - 1 AS slot FROM
  (SELECT vec_id, region, round(sqrt(greatest(0, list_inner_product(e, e) + list_inner_product(c, c) - 2 * list_inner_product(e, c))), 9) AS d FROM v, cents WHERE label IS NOT NULL)),
qdist AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, region) - 1 AS slot FROM
  (SELECT query_id, region, round(sqrt(greatest(0, list_inner_product(e, e) + list_inner_product(c, c) - 2 * list_inner_product(e, c))), 9) AS d FROM q, cents)),
pairs AS MATERIALIZED (SELECT vec_id, min(region) FILTER (slot = 0) AS region, min(d) FILTER (slot = 0) AS d1, min(d) FILTER (slot = 1) AS d2 FROM dist GROUP BY vec_id),
qpairs AS (SELECT query_id, min(region) FILTER (slot = 0) AS region, min(d) FILTER (slot = 0) AS d1, min(d) FILTER (slot = 1) AS d2 FROM qdist GROUP BY query_id)"""


def closure_sql(eps: float = EPS) -> str:
    return f"members AS MATERIALIZED (SELECT a.vec_id, a.slot, a.region, a.d FROM dist a JOIN dist h ON h.vec_id = a.vec_id AND h.slot = 0 WHERE a.slot < 4 AND (a.slot = 0 OR a.d <= h.d * {1 + eps}))"


def found_sql(probe: int = 2, k: int = K) -> str:
    return f"""found AS MATERIALIZED (SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT DISTINCT r.query_id, m.vec_id, s.score FROM qdist r JOIN members m ON m.region = r.region JOIN s ON s.query_id = r.query_id AND s.vec_id = m.vec_id WHERE r.slot < {probe})) WHERE rank <= {k})"""


def recall_sql(have: str, k: int, name: str, where: str = "") -> str:
    return f"SELECT count(h.vec_id) / count(*) AS {name} FROM (SELECT * FROM truth WHERE rank <= {k}) t LEFT JOIN (SELECT DISTINCT query_id, vec_id FROM {have} {where}) h ON h.query_id = t.query_id AND h.vec_id = t.vec_id"


WITH_REGIONS = f"WITH {T}, {C}"
SEARCHED = f"{WITH_REGIONS}, {closure_sql()}, {found_sql()}"


@query(f"WITH {T} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM truth WHERE rank <= 10")
def exact_knn(spark, sf):
    return truth(vectors(spark, sf), K).withColumn("score", F.round("score", 6))


@query(f"WITH {T} SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s WHERE label = 1 QUALIFY rank <= 10")
def knn_over_subset(spark, sf):
    base = vectors(spark, sf)
    return knn.exact(base.where("label = 1"), asked(base), K).drop("score")


@query(f"WITH {T}, n AS (SELECT query_id, vec_id, round(sqrt(greatest(0, 2 - 2 * score)), 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE query_id <> vec_id) SELECT query_id, vec_id, distance, CAST(rank AS INT) AS rank FROM n WHERE rank <= 2")
def two_nearest_others(spark, sf):
    found = truth(vectors(spark, sf), 3).where("query_id <> vec_id")
    return knn.ranked(found.drop("rank"), 2).select("query_id", "vec_id", F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))), 6).alias("distance"), "rank")


@query(f"""WITH {T}, n AS (SELECT query_id, sqrt(greatest(0, 2 - 2 * score)) AS d, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE query_id <> vec_id),
m AS (SELECT query_id, greatest(max(d) FILTER (rank = 2), 1e-6) / greatest(max(d) FILTER (rank = 1), 1e-6) AS mu FROM n WHERE rank <= 2 GROUP BY query_id HAVING max(d) FILTER (rank = 2) > max(d) FILTER (rank = 1)),
o AS (SELECT mu, row_number() OVER (ORDER BY mu, query_id) AS i, count(*) OVER () AS n FROM m)
SELECT round(count(*) / sum(ln(mu)), 6) AS lid, count(*) AS n FROM o WHERE i <= floor(n * 0.9)""")
def two_nn_dimension(spark, sf):
    found = truth(vectors(spark, sf), 3).where("query_id <> vec_id")
    near = knn.ranked(found.drop("rank"), 2).withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))))
    return measures.two_nn(near).withColumn("lid", F.round("lid", 6))


@query(f"WITH {V}, {C} SELECT region, CAST(size AS BIGINT) AS size, round(list_inner_product(c, c), 6) AS squared FROM cents")
def region_centroids(spark, sf):
    c = regions.centroids(labelled(vectors(spark, sf)), "region")
    return c.select(F.col("region").cast("int").alias("region"), "size", F.round(inner(F.col("centroid"), F.col("centroid")), 6).alias("squared"))


@query(f"WITH {V}, {C} SELECT vec_id, CAST(slot AS INT) AS slot, region, round(d, 6) AS d FROM dist WHERE slot < 2")
def centroid_distances(spark, sf):
    return dist_of(vectors(spark, sf), 2).withColumn("d", F.round("d", 6)).withColumn("region", F.col("region").cast("int"))


@query(f"WITH {V}, {C}, {closure_sql()} SELECT vec_id, CAST(slot AS INT) AS slot, region FROM members")
def epsilon_closure(spark, sf):
    return regions.closure(dist_of(vectors(spark, sf)), EPS).select("vec_id", "slot", F.col("region").cast("int").alias("region"))


@query(" UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS eps, copies, count(*) AS vectors FROM (WITH {V}, {C}, {closure_sql(e)} SELECT vec_id, count(*) AS copies FROM members GROUP BY vec_id) GROUP BY copies" for e in (0.1, 0.2, 0.4)))
def copies_histogram(spark, sf):
    dist = dist_of(vectors(spark, sf))
    out = None
    for e in (0.1, 0.2, 0.4):
        h = regions.closure(dist, e).groupBy("vec_id").agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("vectors")).select(F.lit(e).alias("eps"), "copies", "vectors")
        out = h if out is None else out.unionByName(h)
    return out


@query("SELECT vec_id, CAST(('0x' || substr(md5('0:' || CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 8 AS shard FROM embeddings")
def hash_shards(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", regions.hash_shard(F.col("vec_id"), 8).cast("long").alias("shard"))


@query(f"WITH {V}, {C} SELECT query_id, CAST(slot AS INT) AS slot, region, round(d, 6) AS d FROM qdist WHERE slot < 2")
def routing(spark, sf):
    return regions.route(query_dist(vectors(spark, sf)), 2).select("query_id", "slot", F.col("region").cast("int").alias("region"), F.round("d", 6).alias("d"))


@query(f"{SEARCHED} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM found")
def semantic_search(spark, sf):
    return semantic(vectors(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {T}, h AS (SELECT *, CAST(('0x' || substr(md5('0:' || CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS shard FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard, vec_id) AS INT) AS rank FROM h QUALIFY rank <= 10""")
def hash_sharded_search(spark, sf):
    base = vectors(spark, sf)
    return families.hash_search(base, asked(base), shards=3, k=K).withColumn("score", F.round("score", 6))


@query(f"{SEARCHED} {recall_sql('found', 10, 'recall')}")
def recall_at_k(spark, sf):
    base = vectors(spark, sf)
    return metrics.recall(semantic(base), truth(base), K)


@query(f"{SEARCHED} SELECT round(avg(CASE WHEN p.score IS NULL THEN 0 WHEN p.score >= 1 THEN CASE WHEN t.score >= 1 THEN 1 ELSE 0 END ELSE least(1, sqrt(greatest(0, 2 - 2 * t.score)) / sqrt(2 - 2 * p.score)) END), 6) AS inv_ratio FROM truth t LEFT JOIN found p ON p.query_id = t.query_id AND p.rank = 10 WHERE t.rank = 10")
def inverse_distance_ratio(spark, sf):
    base = vectors(spark, sf)
    return metrics.inverse_ratio(semantic(base), truth(base), K).withColumn("inv_ratio", F.round("inv_ratio", 6))


@query(f"{WITH_REGIONS}, {closure_sql()}, reach AS (SELECT r.query_id, m.vec_id FROM qdist r JOIN members m ON m.region = r.region WHERE r.slot < 2), {found_sql()} SELECT round(1 - (SELECT count(h.vec_id) / count(*) FROM (SELECT * FROM truth WHERE rank <= 10) t LEFT JOIN (SELECT DISTINCT * FROM reach) h ON h.query_id = t.query_id AND h.vec_id = t.vec_id), 9) AS routing_loss, round((SELECT count(h.vec_id) / count(*) FROM (SELECT * FROM truth WHERE rank <= 10) t LEFT JOIN (SELECT DISTINCT * FROM reach) h ON h.query_id = t.query_id AND h.vec_id = t.vec_id), 9) AS ceiling, round((SELECT count(h.vec_id) / count(*) FROM (SELECT * FROM truth WHERE rank <= 10) t LEFT JOIN found h ON h.query_id = t.query_id AND h.vec_id = t.vec_id), 9) AS recall")
def routing_ceiling(spark, sf):
    base = vectors(spark, sf)
    reach = regions.route(query_dist(base), 2).join(regions.closure(dist_of(base), EPS).select("vec_id", "region"), "region")
    true = truth(base, K)
    ceiling, got = metrics.present(reach, true, K, "ceiling"), metrics.recall(semantic(base), true, K)
    return ceiling.join(got).select(F.round(1 - F.col("ceiling"), 9).alias("routing_loss"), F.round("ceiling", 9).alias("ceiling"), F.round("recall", 9).alias("recall"))


WIDE = """wide AS MATERIALIZED (SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rough DESC, vec_id) AS rank FROM
  (SELECT q.query_id, v.vec_id, round(list_inner_product(q.e, v.e), 9) AS score, round(list_inner_product(q.e[1:16], v.e[1:16]), 9) AS rough FROM q, v)) WHERE rank <= 30)"""


def rough(base: DataFrame) -> DataFrame:
    """The first pass of a cheap index: only the first 16 components count."""
    short = lambda df: df.withColumn("e", F.slice("e", 1, 16))
    return knn.exact(short(base), short(asked(base)), 30)


@query(f"WITH {V}, {WIDE}, again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM wide) SELECT query_id, vec_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM again WHERE r <= 10")
def exact_rerank(spark, sf):
    base = vectors(spark, sf)
    return knn.rescored(rough(base), base, asked(base), K).withColumn("score", F.round("score", 6))


@query(f"""WITH {T}, {WIDE}, t AS (SELECT * FROM truth WHERE rank <= 10), x AS (SELECT count(w.vec_id) / count(*) AS c, count(w.vec_id) FILTER (w.rank <= 10) / count(*) AS r FROM t LEFT JOIN wide w ON w.query_id = t.query_id AND w.vec_id = t.vec_id)
SELECT round(c, 9) AS candidate_recall, round(r, 9) AS recall_before_rerank, 0.0::DOUBLE AS routing_loss, round(1 - c, 9) AS candidate_loss, round(c - r, 9) AS ordering_loss FROM x""")
def recall_decomposition(spark, sf):
    base = vectors(spark, sf)
    wide, true = rough(base), truth(base, K)
    out = metrics.decomposition(true, wide, wide, true, K)  # one index reaches all rows
    return out.select(*(F.round(c, 9).alias(c) for c in ("candidate_recall", "recall_before_rerank", "routing_loss", "candidate_loss", "ordering_loss")))


@query(f"WITH {V}, {C} SELECT round(avg(CASE WHEN d2 > 1.2 * d1 THEN 1.0 ELSE 0.0 END), 9) AS crispness, count(*) AS n FROM pairs")
def boundary_crispness(spark, sf):
    return measures.crispness(measures.pairs_of_distances(dist_of(vectors(spark, sf), 2))).withColumn("crispness", F.round("crispness", 9))


@query(f"WITH {V}, {C} SELECT round(avg(CASE WHEN d2 <= 1.1 * d1 THEN 1.0 ELSE 0.0 END), 9) AS ambiguous_rate, count(*) AS n FROM qpairs")
def ambiguous_queries(spark, sf):
    return measures.ambiguity(measures.pairs_of_distances(query_dist(vectors(spark, sf), 2), "query_id")).withColumn("ambiguous_rate", F.round("ambiguous_rate", 9))


GRID = f"""WITH {V}, {C}, r AS (SELECT CASE WHEN d1 > 0 THEN d2 / d1 WHEN d2 = 0 THEN 1 END AS ratio FROM pairs),
grid AS (SELECT i * 0.5 AS pct, (SELECT quantile_cont(ratio, i / 200.0) FROM r) AS ratio FROM range(201) t(i))"""


RATIOS = f"WITH {V}, {C}, r AS (SELECT CASE WHEN d1 > 0 THEN d2 / d1 WHEN d2 = 0 THEN 1 END AS ratio FROM pairs)"
STEPS = "[" + ", ".join(str(i / 200) for i in range(201)) + "]"
GRID = f"{RATIOS}, g AS (SELECT quantile_cont(ratio, {STEPS}) AS q, count(*) AS n, count(*) - count(ratio) AS n_infinite FROM r), grid AS (SELECT unnest(range(0, 201)) * 0.5 AS pct, unnest(q) AS ratio, n, n_infinite FROM g)"


def grid_of(spark, sf):
    return measures.ratio_grid(measures.ratios(measures.pairs_of_distances(dist_of(vectors(spark, sf), 2))))


@query(f"{GRID} SELECT CAST(pct AS DOUBLE) AS pct, round(ratio, 6) AS ratio, n, n_infinite FROM grid")
def ratio_quantiles(spark, sf):
    return grid_of(spark, sf).select("pct", F.round("ratio", 6).alias("ratio"), "n", "n_infinite")


THRESHOLD = 1.01  # a place inside the grid: these vectors lie almost evenly
INVERSE = f"""{GRID}, seg AS (SELECT pct, ratio, lead(pct) OVER (ORDER BY pct) AS p1, lead(ratio) OVER (ORDER BY pct) AS r1 FROM grid),
inv AS (SELECT CASE WHEN {THRESHOLD} <= (SELECT min(ratio) FROM grid) THEN 0 WHEN {THRESHOLD} >= (SELECT max(ratio) FROM grid) THEN 100
  ELSE (SELECT max(pct + ({THRESHOLD} - ratio) / (r1 - ratio) * (p1 - pct)) FROM seg WHERE ratio <= {THRESHOLD} AND r1 > {THRESHOLD}) END::DOUBLE AS percentile)"""


@query(f"{INVERSE} SELECT round(percentile, 6) AS percentile FROM inv")
def threshold_percentile(spark, sf):
    return measures.percentile_of(grid_of(spark, sf), THRESHOLD).select(F.round("percentile", 6).alias("percentile"))


@query(f"""{INVERSE} SELECT round(CASE WHEN {THRESHOLD} <= (SELECT min(ratio) FROM grid) THEN 1 WHEN {THRESHOLD} >= (SELECT max(ratio) FROM grid) THEN (SELECT max(n_infinite) / max(n) FROM grid) ELSE (100 - percentile) / 100 END, 6) AS share FROM inv""")
def count_from_grid(spark, sf):
    return measures.count_from(grid_of(spark, sf), THRESHOLD).select(F.round("share", 6).alias("share"))


def reading_sql(pairs: str, threshold: float, away: str, share: str) -> str:
    return f"""x AS (SELECT {share.format(t=threshold)} AS share, count(*) AS n FROM {pairs}), y AS (SELECT share, n, CAST(round_even(({away}) * n, 0) AS BIGINT) AS informative, ({away}) / sqrt(greatest(share * (1 - share), 1e-12) / n) AS s FROM x)
SELECT round(share, 9) AS share, n, informative, round(CASE WHEN n > 0 AND informative >= 5 THEN s ELSE 0 END, 6) AS sigma, CASE WHEN informative >= 5 AND s >= 3 THEN 'measured' ELSE 'couldnt_check' END AS outcome FROM y"""


def read_of(df):
    return df.select(F.round("share", 9).alias("share"), "n", "informative", F.round("sigma", 6).alias("sigma"), "outcome")


@query(f"WITH {V}, {C}, {reading_sql('pairs', THRESHOLD, 'share', 'avg(CASE WHEN d2 > {t} * d1 THEN 1.0 ELSE 0.0 END)')}")
def crispness_reading(spark, sf):
    return read_of(measures.reading(measures.pairs_of_distances(dist_of(vectors(spark, sf), 2)), THRESHOLD, 0.0, measures.PUBLISHED_CRISP))


@query(f"WITH {V}, {C}, {reading_sql('qpairs', measures.AMBIGUOUS, '1 - share', 'avg(CASE WHEN d2 <= {t} * d1 THEN 1.0 ELSE 0.0 END)')}")
def ambiguity_reading(spark, sf):
    return read_of(measures.reading(measures.pairs_of_distances(query_dist(vectors(spark, sf), 2), "query_id"), measures.AMBIGUOUS, 1.0, measures.PUBLISHED_AMBIGUOUS))


@query(f"""WITH {V}, {C}, c AS (SELECT cents.region, count(p.vec_id) AS c FROM cents LEFT JOIN pairs p ON p.region = cents.region GROUP BY cents.region),
o AS (SELECT c, row_number() OVER (ORDER BY c DESC, region) AS i FROM c)
SELECT round(sum(c) FILTER (i <= 10) / sum(c), 9) AS top_share, count(*) AS regions, round(10.0 / count(*), 9) AS even_share, round(sum(c) FILTER (i <= 10) / sum(c) / (10.0 / count(*)), 9) AS excess, CAST(count(*) FILTER (c = 0) AS BIGINT) AS empty_regions, max(c) AS largest FROM o""")
def region_skew(spark, sf):
    base = vectors(spark, sf)
    out = measures.skew(dist_of(base, 1).select("vec_id", "region"), cents_of(base))
    return out.withColumns({c: F.round(c, 9) for c in ("top_share", "even_share", "excess")})


#: Times of vectors, as strings: a month by the id.
MONTH = "'2020-' || lpad(CAST(vec_id % 12 + 1 AS VARCHAR), 2, '0')"
DRIFT = f"""{T}, times AS (SELECT vec_id, {MONTH} AS tm FROM v), cut AS (SELECT min(tm) AS cutoff FROM (SELECT tm, row_number() OVER (ORDER BY tm) AS i, count(*) OVER () AS n FROM times) WHERE i = CAST(floor(n / 2) AS BIGINT) + 1),
old AS (SELECT v.* FROM v JOIN times USING (vec_id), cut WHERE tm < cutoff AND label IS NOT NULL),
cents AS MATERIALIZED (SELECT region, list(x ORDER BY i) AS c FROM (SELECT label AS region, i, round(avg(e[i]), 9) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM old) GROUP BY label, i) GROUP BY region),
near AS MATERIALIZED (SELECT vec_id, region FROM (SELECT vec_id, region, row_number() OVER (PARTITION BY vec_id ORDER BY round(sqrt(greatest(0, list_inner_product(e, e) + list_inner_product(c, c) - 2 * list_inner_product(e, c))), 9), region) AS i FROM v, cents) WHERE i = 1),
half AS (SELECT t.query_id, ti.tm < cutoff AS early, count(*) FILTER (h.region = a.region) AS hit, count(*) AS n FROM (SELECT * FROM truth WHERE rank <= 10) t JOIN near a ON a.vec_id = t.query_id JOIN near h ON h.vec_id = t.vec_id JOIN times ti ON ti.vec_id = t.query_id, cut GROUP BY ALL)"""


def months(df, id_="vec_id"):
    return F.concat(F.lit("2020-"), F.lpad((F.col(id_) % 12 + 1).cast("string"), 2, "0"))


def drifted(base):
    """Centroids are label means of the rows before the cutoff."""
    times = base.select("vec_id", months(base).alias("at"))
    cut = measures.cutoff_of(times, None).first()[0]
    cents = regions.centroids(labelled(base).where(months(base) < cut), "region")
    q = asked(base)
    return measures.drift(truth(base, K), regions.distances(base, cents, 1), regions.distances(q, cents, 1, id_="query_id"), q.select("query_id", months(q, "query_id").alias("at")), None, times)


@query(f"WITH {DRIFT} SELECT round(sum(hit) FILTER (early) / sum(n) FILTER (early), 9) AS before, round(sum(hit) FILTER (NOT early) / sum(n) FILTER (NOT early), 9) AS after, CAST(count(*) FILTER (early) AS BIGINT) AS n_before, CAST(count(*) FILTER (NOT early) AS BIGINT) AS n_after, (SELECT cutoff FROM cut) AS cutoff FROM half")
def drift_pair(spark, sf):
    return drifted(vectors(spark, sf)).select(F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), "n_before", "n_after", "cutoff")


@query(f"""WITH {V}, {C}, {closure_sql()}, k AS (SELECT vec_id, count(*) AS c FROM members GROUP BY vec_id)
SELECT CAST(sum(c) AS BIGINT) AS stored, round(sum(c) / count(*), 9) AS amplification, CAST(floor(quantile_cont(c, 0.5)) AS BIGINT) AS copies_p50, CAST(floor(quantile_cont(c, 0.95)) AS BIGINT) AS copies_p95, CAST(floor(quantile_cont(c, 0.99)) AS BIGINT) AS copies_p99, CAST(sum(c) * 64 * 4 AS BIGINT) AS memory_bytes FROM k""")
def footprint(spark, sf):
    return families.footprint(regions.closure(dist_of(vectors(spark, sf)), EPS), dim=64, links=0).withColumn("amplification", F.round("amplification", 9))


#: Answers of each probed region before they are merged.
STATE = f"""{WITH_REGIONS.replace("round(list_inner_product(q.e, v.e), 9) AS score FROM q, v)", "round(list_inner_product(q.e, v.e), 9) AS score FROM q, v WHERE label IS NOT NULL)")}, {closure_sql()},
probed AS (SELECT query_id, slot, region FROM qdist WHERE slot < 2), true10 AS (SELECT * FROM truth WHERE rank <= 10),
cand0 AS MATERIALIZED (SELECT p.query_id, m.region AS shard, m.vec_id, s.score FROM probed p JOIN members m ON m.region = p.region JOIN s ON s.query_id = p.query_id AND s.vec_id = m.vec_id QUALIFY row_number() OVER (PARTITION BY p.query_id, m.region ORDER BY s.score DESC, m.vec_id) <= 30),
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY score DESC, shard) = 1 AS survived FROM cand0)"""


@query(f"{STATE} SELECT c.query_id, c.shard, c.vec_id, round(c.score, 6) AS score, survived, CAST(coalesce(t.rank, -1) AS INT) AS true_rank FROM cand c LEFT JOIN true10 t ON t.query_id = c.query_id AND t.vec_id = c.vec_id")
def candidate_state(spark, sf):
    return state_of(vectors(spark, sf)).candidates.select("query_id", F.col("shard").cast("int").alias("shard"), "vec_id", F.round("score", 6).alias("score"), "survived", "true_rank")


@query(f"""{STATE} SELECT c.region, (SELECT count(*) FROM members m WHERE m.region = c.region) AS vectors_held, (SELECT count(DISTINCT query_id) FROM probed r WHERE r.region = c.region) AS queries_served, (SELECT count(*) FROM cand x WHERE x.shard = c.region) AS candidates_contributed FROM cents c""")
def load_per_region(spark, sf):
    return state_of(vectors(spark, sf)).load.withColumn("region", F.col("region").cast("int"))


@query(f"""{STATE.replace(closure_sql(), closure_sql(0.1))}, per AS (SELECT vec_id, count(*) AS c FROM members GROUP BY vec_id), lists AS (SELECT list_sort(list(c)) AS l, count(*) AS n, sum(c) AS total, count(*) FILTER (c > 1) AS copied FROM per),
reach AS (SELECT t.query_id, t.vec_id, bool_or(p.query_id IS NOT NULL) AS hit FROM true10 t LEFT JOIN members m ON m.vec_id = t.vec_id LEFT JOIN probed p ON p.query_id = t.query_id AND p.region = m.region GROUP BY ALL)
SELECT n AS vectors, CAST(copied AS BIGINT) AS vectors_copied, round(total / n, 9) AS amplification, l[CAST(floor((n - 1) * 0.99) AS BIGINT) + 1] AS p99_copies, CAST(total AS BIGINT) AS vectors_held,
  round((SELECT avg(CASE WHEN d2 > 1.2 * d1 THEN 1.0 ELSE 0.0 END) FROM pairs), 9) AS crispness, round((SELECT avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FROM reach), 9) AS ceiling FROM lists""")
def ground_view(spark, sf):
    """Recounted at an epsilon that wasn't simulated: only what geometry tells."""
    return views.ground(state_of(vectors(spark, sf)), 0.1, K).withColumns({c: F.round(c, 9) for c in ("amplification", "crispness", "ceiling")})


INDEX = f"""{STATE}, home AS (SELECT vec_id, region AS home FROM members WHERE slot = 0), named AS (SELECT t.query_id, p.region AS routed_region, count(*) AS located, count(*) FILTER (h.home <> p.region) AS outside FROM true10 t JOIN probed p ON p.query_id = t.query_id AND p.slot = 0 LEFT JOIN home h ON h.vec_id = t.vec_id GROUP BY ALL),
top AS (SELECT query_id, vec_id FROM cand WHERE survived QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard, vec_id) <= 10),
hits AS (SELECT t.query_id, CAST(count(x.vec_id) AS BIGINT) AS hits FROM true10 t LEFT JOIN top x ON x.query_id = t.query_id AND x.vec_id = t.vec_id GROUP BY t.query_id),
missed AS (SELECT t.query_id, CAST(count(*) FILTER (c.vec_id IS NULL) AS BIGINT) AS missed_by_route FROM true10 t LEFT JOIN (SELECT DISTINCT query_id, vec_id FROM cand) c ON c.query_id = t.query_id AND c.vec_id = t.vec_id GROUP BY t.query_id)"""


@query(f"{INDEX} SELECT n.query_id, routed_region, located, CASE WHEN located = 10 THEN outside END AS outside_routed_region, round(CASE WHEN d1 > 0 THEN d2 / d1 END, 6) AS distance_ratio, d2 <= 1.1 * d1 AS ambiguous, hits, missed_by_route FROM named n JOIN qpairs USING (query_id) JOIN hits USING (query_id) JOIN missed USING (query_id)")
def query_index(spark, sf):
    return views.query_index(state_of(vectors(spark, sf)), K).withColumn("distance_ratio", F.round("distance_ratio", 6)).withColumn("routed_region", F.col("routed_region").cast("int"))


@query(f"{INDEX} SELECT CAST(t.rank AS INT) AS rank, t.vec_id, h.home AS home_region, p.region AS routed_region, h.home <> p.region AS outside, c.vec_id IS NULL AS missed_by_route, x.vec_id IS NOT NULL AS found FROM true10 t JOIN probed p ON p.query_id = t.query_id AND p.slot = 0 LEFT JOIN home h ON h.vec_id = t.vec_id LEFT JOIN (SELECT DISTINCT query_id, vec_id FROM cand) c ON c.query_id = t.query_id AND c.vec_id = t.vec_id LEFT JOIN top x ON x.query_id = t.query_id AND x.vec_id = t.vec_id WHERE t.query_id = 100")
def query_trace(spark, sf):
    """One query, which is the feature."""
    return views.query_trace(state_of(vectors(spark, sf)), 100, K).withColumns({c: F.col(c).cast("int") for c in ("home_region", "routed_region")})


@query(f"{SEARCHED} SELECT f.query_id, f.vec_id, CAST(coalesce(t.rank, -1) AS INT) AS true_rank FROM found f LEFT JOIN truth t ON t.query_id = f.query_id AND t.vec_id = f.vec_id")
def true_ranks(spark, sf):
    base = vectors(spark, sf)
    return state.true_rank(semantic(base), truth(base)).select("query_id", "vec_id", "true_rank")


BROKEN = [
    ("a candidate comes from a known shard", 1), ("a candidate comes from a probed region", 1), ("loads hold all copies", 1), ("the nearest region is the home", 1), ("a copy lies in the region of its slot", 1),
    ("a home lies in a known region", 1), ("a copy lies in a known region", 1), ("sizes count the homes", 1), ("every query has all its true neighbours", 1), ("a true neighbour is a known vector", 1), ("every vector has a finite place", 1),
]


@query(f"SELECT * FROM (VALUES {', '.join(f'($${r}$$, {n}::BIGINT)' for r, n in BROKEN)}) t(rule, violations)")
def state_contract(spark, sf):
    """The rules that planted breaks break, and no others: a home out of all regions, a candidate from no shard, a load one off, a true neighbour that isn't there, a place that is missing."""
    base = vectors(spark, sf)
    s = state_of(base)
    if (found := state.violations(s).count()) > 0:
        raise AssertionError(f"{found} rules don't hold before anything is broken")
    at = lambda df, c: df.agg(F.min(c)).first()[0]
    one, query_ = at(s.base, "vec_id"), at(s.queries, "query_id")
    s.copies = s.copies.withColumn("region", F.when((F.col("vec_id") == one) & (F.col("slot") == 0), 999).otherwise(F.col("region")))
    first = s.candidates.where(F.col("query_id") == query_).orderBy("shard", F.desc("score"), "vec_id").first()
    s.candidates = s.candidates.withColumn("shard", F.when((F.col("query_id") == query_) & (F.col("vec_id") == first.vec_id) & (F.col("shard") == first.shard), 999).otherwise(F.col("shard")))
    s.load = s.load.withColumn("vectors_held", F.col("vectors_held") + (F.col("region") == at(s.regions, "region")).cast("long"))
    s.truth = s.truth.where(~((F.col("query_id") == query_) & (F.col("rank") == s.true_k))).withColumn("vec_id", F.when((F.col("query_id") == query_) & (F.col("rank") == 2) & (F.col("vec_id") >= 0), -7).otherwise(F.col("vec_id")))
    s.candidates = state.true_rank(s.candidates.drop("true_rank"), s.truth)
    s.spots = s.base.where(F.col("vec_id") != one).select("vec_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return state.violations(s)


@query(f"WITH {V}, {C} SELECT c.region, round(avg(e[1]), 6) AS x, round(avg(e[2]), 6) AS y FROM cents c LEFT JOIN pairs p ON p.region = c.region LEFT JOIN v ON v.vec_id = p.vec_id GROUP BY c.region")
def region_placement(spark, sf):
    base = vectors(spark, sf)
    spots = base.select("vec_id", F.get("e", F.lit(0)).alias("x"), F.get("e", F.lit(1)).alias("y"))
    out = state.region_placement(dist_of(base, 1), spots, cents_of(base))
    return out.select(F.col("region").cast("int").alias("region"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {T} SELECT query_id, round(avg(e[1]), 6) AS x, round(avg(e[2]), 6) AS y FROM truth JOIN v USING (vec_id) WHERE rank <= 10 GROUP BY query_id")
def query_placement(spark, sf):
    base = vectors(spark, sf)
    spots = base.select("vec_id", F.get("e", F.lit(0)).alias("x"), F.get("e", F.lit(1)).alias("y"))
    return state.query_placement(truth(base, K), spots, K).select("query_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {V}, {C}, a AS (SELECT vec_id, region, d FROM dist WHERE slot = 0), b AS (SELECT vec_id, region, d * 1.001 AS d FROM dist WHERE slot = 0 AND vec_id % 10 <> 3) SELECT vec_id, b.vec_id IS NULL AS alone FROM a LEFT JOIN b USING (vec_id) WHERE b.vec_id IS NULL OR abs(a.d - b.d) > 0.0009")
def state_differences(spark, sf):
    """Two emissions of one table, the second stretched and without some rows."""
    one = dist_of(vectors(spark, sf), 1)
    two = one.where("vec_id % 10 <> 3").withColumn("d", F.col("d") * 1.001)
    return state.differences(one, two, ["vec_id"], "d", 0.0009).select("vec_id", F.col("y").isNull().alias("alone"))


KMEANS, ROUNDS = 8, 20


def lloyd_sql() -> str:
    parts = [V, f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('0:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS region, e AS c FROM v QUALIFY region < {KMEANS})"]
    for i in range(ROUNDS):
        parts.append(f"h{i} AS MATERIALIZED (SELECT vec_id, e, arg_min(region, (d, region)) AS region FROM (SELECT vec_id, e, region, round(sqrt(greatest(0, list_inner_product(e, e) + list_inner_product(c, c) - 2 * list_inner_product(e, c))), 9) AS d FROM v, c{i}) GROUP BY vec_id, e)")
        parts.append(f"m{i} AS MATERIALIZED (SELECT region, list(x ORDER BY i) AS c, max(n) AS n FROM (SELECT region, i, round(avg(e[i]), 9) AS x, count(*) AS n FROM (SELECT region, e, unnest(range(1, len(e) + 1)) AS i FROM h{i}) GROUP BY region, i) GROUP BY region)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.region, coalesce(m.c, c.c) AS c, coalesce(m.n, 0) AS n FROM c{i} c LEFT JOIN m{i} m USING (region))")
    return f"WITH {', '.join(parts)} SELECT region, CAST(n AS BIGINT) AS size, round(list_inner_product(c, c), 6) AS squared, round(c[1], 6) AS first FROM c{ROUNDS}"


@query(lloyd_sql())
def kmeans_regions(spark, sf):
    c = regions.lloyd(vectors(spark, sf), KMEANS, ROUNDS, 0)
    return c.select("region", "size", F.round(inner(F.col("centroid"), F.col("centroid")), 6).alias("squared"), F.round(F.get("centroid", F.lit(0)), 6).alias("first"))


@query(f"{WITH_REGIONS.replace('FROM v, cents WHERE label IS NOT NULL', 'FROM v, cents')}, {closure_sql(0.0)}, {found_sql(4)} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM found")
def ivf_cells_search(spark, sf):
    """The inverted file over given cells."""
    base = vectors(spark, sf)
    return families.ivf_search(base, asked(base), nprobe=4, k=K, cells=cents_of(base)).withColumn("score", F.round("score", 6))


@query()
def ivf_search(spark, sf):
    base = vectors(spark, sf)
    return families.ivf_search(base, asked(base), nlist=16, nprobe=13, k=K)


@query()
def ivf_pq_search(spark, sf):
    base = vectors(spark, sf)
    return families.ivf_pq_search(base, asked(base), nlist=8, nprobe=7, m=16, nbits=4, k=K, rerank=20)


@query()
def hnsw_search(spark, sf):
    base = vectors(spark, sf)
    return families.hnsw_search(base, asked(base), links=16, ef_build=64, ef=64, k=K)


CONFIGURATIONS = [("single_node", {}), ("hash_sharded", {"shards": 3}), ("semantic_sharded", {"centroids": 8, "eps": 0.2, "probe": 2}), ("semantic_sharded", {"centroids": 8, "eps": 0.0, "probe": 1}), ("semantic_sharded", {"centroids": 1_000_000, "eps": 0.0, "probe": 1})]


@query()
def architecture_sweep(spark, sf):
    base = vectors(spark, sf)
    return families.sweep(base, asked(base), truth(base, 100), CONFIGURATIONS)[0]


@query(f"""WITH {T}, {C} SELECT 'boundary_crispness' AS measure, CASE WHEN avg(CASE WHEN d2 > 1.2 * d1 THEN 1.0 ELSE 0.0 END) * count(*) < 5 THEN 'couldnt_check' ELSE 'measured' END AS outcome FROM pairs
UNION ALL SELECT 'skew_top10_share', 'measured' UNION ALL SELECT 'intrinsic_dimensionality', 'measured' UNION ALL SELECT 'ambiguous_query_rate', 'couldnt_check' UNION ALL SELECT 'drift_before', 'measured' UNION ALL SELECT 'drift_after', 'measured'""")
def characterized(spark, sf):
    """The five measures together; with so few queries (or all of them ambiguous) their rate can't be checked."""
    base = vectors(spark, sf)
    near = knn.ranked(truth(base, 3).where("query_id <> vec_id").drop("rank"), 2).withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))))
    q = query_dist(base, 2)
    rows = measures.characterized(
        dimension=measures.two_nn(near), homes=dist_of(base, 1), regions=cents_of(base), base=measures.pairs_of_distances(dist_of(base, 2)), queries=measures.pairs_of_distances(q, "query_id"), n_queries=asked(base).count(), drifted=drifted(base)
    )
    return rows.select("measure", "outcome")


@query(f"WITH {T} SELECT avg(CASE WHEN abs(a.score - b.score) <= 1e-6 THEN 1.0 ELSE 0.0 END) AS tied FROM truth a LEFT JOIN truth b ON b.query_id = a.query_id AND b.rank = 11 WHERE a.rank = 10")
def tie_bound(spark, sf):
    return metrics.tie_bound(truth(vectors(spark, sf)), K)


@query(f"{SEARCHED} SELECT round(avg(r), 9) AS distance_recall FROM (SELECT t.query_id, (SELECT count(*) FROM found f WHERE f.query_id = t.query_id AND f.score >= t.score - 1e-6) / 10.0 AS r FROM truth t WHERE t.rank = 10)")
def distance_recall(spark, sf):
    base = vectors(spark, sf)
    return metrics.distance_recall(semantic(base), truth(base), K).withColumn("distance_recall", F.round("distance_recall", 9))


@query(f"WITH {T} SELECT avg(CASE WHEN vec_id < (SELECT count(*) // 2 FROM v) THEN 1.0 ELSE 0.0 END) AS reachable FROM truth WHERE rank <= 10")
def reachability(spark, sf):
    """Neighbours that a base of half the rows can still name."""
    base = vectors(spark, sf)
    return metrics.reachability(truth(base, K), base.count() // 2)


@query(f"WITH {T}, {WIDE} {recall_sql('wide', 10, 'agreement', 'WHERE rank <= 10')}")
def metric_agreement(spark, sf):
    base = vectors(spark, sf)
    return metrics.metric_agreement(rough(base), truth(base, K), K)


@query(f"WITH {V} SELECT a.vec_id, round(list_inner_product(a.e, b.e), 6) AS inner_product, round(-list_distance(a.e, b.e), 6) AS l2 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def pair_metrics(spark, sf):
    base = vectors(spark, sf)
    both = base.select("vec_id", F.col("e").alias("a")).join(base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b")), "vec_id")
    one = engine.pairwise(both, "inner_product").select("vec_id", F.round("score", 6).alias("inner_product"))
    return one.join(engine.pairwise(both, "l2").select("vec_id", F.round("score", 6).alias("l2")), "vec_id")
