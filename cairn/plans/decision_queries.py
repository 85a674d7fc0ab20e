"""Queries of the decision layer. Rows of configurations are stood in for by figures over `customer` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import families, metrics, verdicts
from cairn.plans.registry import Literal, query, table

R = """r AS MATERIALIZED (SELECT CAST(c_nationkey AS VARCHAR) AS config, c_mktsegment AS engine, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS recall, count(*) / 4.0 AS amplification, max(c_acctbal) AS p95 FROM customer GROUP BY ALL),
v AS MATERIALIZED (SELECT config, engine, 'recall' AS "constraint", recall AS value, 0.8 AS threshold, CASE WHEN recall IS NULL THEN 'couldnt_check' WHEN recall >= 0.8 THEN 'meets' ELSE 'fails' END AS outcome FROM r
UNION ALL SELECT config, engine, 'storage', amplification, 4, CASE WHEN amplification <= 4 THEN 'meets' ELSE 'fails' END FROM r
UNION ALL SELECT config, engine, 'memory', NULL, 1, 'couldnt_check' FROM r),
c AS (SELECT config, "constraint", CASE WHEN bool_or(outcome = 'meets') THEN 'meets' WHEN bool_and(outcome = 'fails') THEN 'fails' ELSE 'couldnt_check' END AS outcome FROM v GROUP BY ALL),
two AS (SELECT * FROM c WHERE "constraint" <> 'memory'),
o AS (SELECT config, CASE WHEN bool_or(outcome = 'fails') THEN 'fails' WHEN bool_and(outcome = 'meets') THEN 'meets' ELSE 'couldnt_check' END AS outcome FROM two GROUP BY config),
s AS (SELECT config, avg(recall) AS recall, round(avg(amplification), 9) AS amplification, count(*) AS fanout FROM r GROUP BY config)"""


def rows_of(spark, sf):
    df = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("config"), F.col("c_mktsegment").alias("engine"))
    return df.agg(F.avg((F.col("c_acctbal") > 0).cast("double")).alias("recall"), (F.count("*") / 4.0).alias("amplification"), F.max("c_acctbal").alias("p95"))


def verdict_rows(spark, sf):
    return verdicts.judged(rows_of(spark, sf), [("recall", "recall", ">=", 0.8), ("storage", "amplification", "<=", 4.0), ("memory", "memory_gb", "<=", 1.0)])


def outcomes(spark, sf):
    collapsed = verdicts.over_engines(verdict_rows(spark, sf)).where("constraint <> 'memory'")
    return verdicts.overall(rows_of(spark, sf), collapsed)


def summary(spark, sf):
    return rows_of(spark, sf).groupBy("config").agg(F.avg("recall").alias("recall"), F.round(F.avg("amplification"), 9).alias("amplification"), F.count("*").alias("fanout"))


@query(f'WITH {R} SELECT config, engine, "constraint", round(value, 9) AS value, outcome FROM v')
def constraint_verdicts(spark, sf):
    return verdict_rows(spark, sf).select("config", "engine", "constraint", F.round("value", 9).alias("value"), "outcome")


@query(f'WITH {R} SELECT config, "constraint", outcome FROM c')
def verdicts_over_engines(spark, sf):
    return verdicts.over_engines(verdict_rows(spark, sf))


@query(f"WITH {R} SELECT config, outcome FROM o")
def overall_outcomes(spark, sf):
    return outcomes(spark, sf)


@query(f"WITH {R} SELECT config, engine FROM v GROUP BY ALL HAVING bool_or(outcome = 'meets') AND NOT bool_or(outcome = 'fails')")
def engines_meeting(spark, sf):
    return verdicts.engines_meeting(verdict_rows(spark, sf))


@query(f"WITH {R}, ok AS (SELECT s.* FROM s JOIN o USING (config) WHERE outcome <> 'fails') SELECT a.config, string_agg(b.config, ',' ORDER BY b.config) AS others FROM ok a JOIN ok b ON a.config <> b.config AND abs(a.recall - b.recall) < 0.01 GROUP BY a.config")
def indistinguishable_pairs(spark, sf):
    return verdicts.indistinguishable(summary(spark, sf), outcomes(spark, sf))


@query(f"""WITH {R}, m AS (SELECT config, count(*) FILTER (outcome = 'meets' AND CASE WHEN "constraint" = 'recall' THEN value < threshold * 1.1 ELSE value > threshold * 0.9 END) AS margins FROM v GROUP BY config)
SELECT s.config, margins, amplification, fanout, CAST(row_number() OVER (ORDER BY margins, amplification, fanout, s.config) AS INT) AS place FROM s JOIN o USING (config) JOIN m USING (config) WHERE outcome = 'meets'""")
def option_ranking(spark, sf):
    return verdicts.ranking(summary(spark, sf).drop("recall"), outcomes(spark, sf), verdict_rows(spark, sf))


@query("WITH p AS (SELECT event_type, user_id % 3 AS run, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL) SELECT event_type, CASE WHEN max(p95) <= 300 THEN 'meets' WHEN min(p95) > 300 THEN 'fails' ELSE 'couldnt_check' END AS outcome, round(min(p95), 6) AS least, round(max(p95), 6) AS most FROM p GROUP BY event_type")
def latency_verdicts(spark, sf):
    runs = metrics.latency(table(spark, sf, "events").withColumn("run", F.col("user_id") % 3), "value", "event_type", "run")
    return verdicts.judged_runs(runs, 300.0, "event_type").withColumns({c: F.round(c, 6) for c in ("least", "most")})


NODES = [("small", 16.0, 0.2), ("large", 64.0, 0.7), ("huge", 256.0, 3.1)]


@query("""WITH n(node, memory_gb, price) AS (VALUES ('small', 16.0::DOUBLE, 0.2::DOUBLE), ('large', 64.0, 0.7), ('huge', 256.0, 3.1)), x AS (SELECT CAST(s_nationkey AS VARCHAR) AS config, CAST(count(*) AS DOUBLE) * 20 AS gb FROM supplier GROUP BY 1),
p AS (SELECT config, node, greatest(1, CAST(ceil(gb / (memory_gb * 0.7)) AS BIGINT)) AS nodes, greatest(1, ceil(gb / (memory_gb * 0.7))) * price * 730 AS cost FROM x, n WHERE memory_gb <= 100)
SELECT config, node, nodes, round(cost, 6) AS cost, round(cost * 1.25, 6) AS high, CASE WHEN cost * 1.25 <= 5000 THEN 'meets' ELSE 'fails' END AS outcome FROM p QUALIFY row_number() OVER (PARTITION BY config ORDER BY cost, node) = 1""")
def node_costs(spark, sf):
    needs = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("config")).agg((F.count("*").cast("double") * 20).alias("gb"))
    out = verdicts.budget(verdicts.node_cost(needs, spark.createDataFrame(NODES, "node string, memory_gb double, price double"), most_gb=100.0), 5000.0)
    return out.select("config", "node", "nodes", F.round("cost", 6).alias("cost"), F.round("high", 6).alias("high"), "outcome")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_lines(spark, sf):
    return verdicts.latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query(f"WITH {R} SELECT config, round(recall, 9) AS measured, CASE WHEN abs(recall - 0.9) <= 0.02 THEN 'verified' ELSE 'contradicted' END AS outcome FROM s")
def published_values(spark, sf):
    rows = summary(spark, sf).select("config", F.col("recall").alias("measured"), F.lit(0.9).alias("published"), F.lit(0.02).alias("tolerance"))
    return verdicts.calibrated(rows).select("config", F.round("measured", 9).alias("measured"), "outcome")


@query("WITH d AS (SELECT event_type, round(avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0), 6) AS change FROM events GROUP BY event_type) SELECT event_type, change, CASE WHEN abs(change - 0.5) < 0.1 THEN 'couldnt_check' WHEN change > 0.5 THEN 'held' ELSE 'did_not_hold' END AS outcome FROM d")
def prediction_outcomes(spark, sf):
    side = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    rows = table(spark, sf, "events").groupBy("event_type").agg(side(0).alias("before"), side(1).alias("after"))
    rows = rows.withColumns({"direction": F.lit("rises"), "threshold": F.lit(0.5), "tolerance": F.lit(0.1)})
    return verdicts.predictions(rows).select("event_type", "change", "outcome")


@query("WITH a AS (SELECT CAST(n_nationkey AS VARCHAR) AS path, n_name AS x FROM nation), b AS (SELECT CAST(s_nationkey AS VARCHAR) AS path, CAST(count(*) AS VARCHAR) AS y FROM supplier GROUP BY 1) SELECT path, x, y FROM a FULL JOIN b USING (path) WHERE x IS DISTINCT FROM y AND path <> '0'")
def replay_differences(spark, sf):
    one = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.col("n_name").alias("value"))
    two = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("path")).agg(F.count("*").cast("string").alias("value"))
    return verdicts.replayed(one, two, ("0",))


LOADS = Literal("l", "config VARCHAR, achieved_qps DOUBLE, target_qps DOUBLE, duration DOUBLE, completed BIGINT, errors BIGINT", [
    ("held", 199.9, 200.0, 300.0, 59_900, 0), ("short", 150.0, 200.0, 300.0, 45_000, 0), ("errors", 199.9, 200.0, 300.0, 60_000, 3), ("free", 381.0, 0.0, 60.0, 22_860, 0), ("slow", 90.0, None, 60.0, 5_400, 0), ("none", None, None, None, None, None),
])


@query(f"""WITH {LOADS.sql()} SELECT config, CASE WHEN achieved_qps IS NULL THEN 'couldnt_check' WHEN coalesce(target_qps, 0) <= 0 THEN CASE WHEN achieved_qps >= 100 THEN 'meets' ELSE 'fails' END
WHEN errors > 0 THEN 'fails' WHEN target_qps * duration - completed <= duration THEN 'meets' ELSE 'fails' END AS outcome FROM l""")
def qps_verdicts(spark, sf):
    return verdicts.throughput(LOADS.frame(spark), 100.0).select("config", "outcome")


LATENCIES = Literal("t", "config VARCHAR, engine VARCHAR, kind VARCHAR, environment VARCHAR, concurrency BIGINT, p95 DOUBLE", [
    ("a", "e", "load", "pod", 32, 38.2), ("a", "e", "load", "pod", 32, 39.0), ("b", "e", "load", "pod", 32, 38.2), ("b", "e", "load", "pod", 32, 42.8), ("c", "e", "load", "pod", 32, 50.0), ("d", "e", "single", "pod", 1, 5.0), ("f", "e", "load", "lap", 32, 5.0), ("g", "e", "load", "pod", 8, 5.0),
])
ASKED = Literal("k", "config VARCHAR", [(c,) for c in "abcdfgh"])


@query(f"""WITH {LATENCIES.sql()}, {ASKED.sql()}, u AS (SELECT k.config, engine, p95, CASE WHEN p95 IS NULL THEN 'not verified' WHEN kind <> 'load' THEN 'not measured: load' WHEN environment IS DISTINCT FROM 'pod' THEN 'measured in another environment' WHEN concurrency IS DISTINCT FROM 32 THEN 'measured at another concurrency' END AS wrong FROM k LEFT JOIN t USING (config)),
g AS (SELECT config, engine, max(p95) FILTER (wrong IS NULL) AS most, min(p95) FILTER (wrong IS NULL) AS least, min(wrong) AS wrong FROM u GROUP BY ALL)
SELECT config, engine, CASE WHEN most IS NULL THEN 'couldnt_check' WHEN most <= 40 THEN 'meets' WHEN least > 40 THEN 'fails' ELSE 'couldnt_check' END AS outcome, CASE WHEN most <= 40 THEN most WHEN least > 40 THEN least END AS value, CASE WHEN most IS NULL THEN wrong WHEN most > 40 AND least <= 40 THEN 'the cap lies between the runs' ELSE 'against 40.0 ms' END AS reason FROM g""")
def latency_rules(spark, sf):
    return verdicts.latency(ASKED.frame(spark), LATENCIES.frame(spark), {"p95_ms": 40.0, "concurrency": 32, "environment": "pod"})


BUILT = Literal("x", "config VARCHAR, family VARCHAR, m VARCHAR, ef VARCHAR", [("a", "single_node_hnsw", "32", "128"), ("b", "single_node_hnsw", "16", "128"), ("c", "single_node_hnsw", "16", "64"), ("d", "semantic_sharded", "32", "128"), ("e", "single_node_hnsw", "32.0", None)])


@query(f"""WITH {BUILT.sql()} SELECT config, CASE WHEN family <> 'single_node_hnsw' THEN 'simulated as ' || family || ', never built' ELSE nullif(concat_ws('; ', CASE WHEN CAST(m AS DOUBLE) <> 32 THEN 'M=' || m || ', built m=32' END, CASE WHEN CAST(ef AS DOUBLE) <> 128 THEN 'efSearch=' || ef || ', built hnsw_ef=128' END), '') END AS mismatch FROM x""")
def config_mismatches(spark, sf):
    rows = BUILT.frame(spark).select("config", "family", F.create_map(F.lit("M"), F.col("m"), F.lit("efSearch"), F.col("ef")).alias("params"))
    built = spark.createDataFrame([("e", {"m": "32", "hnsw_ef": "128", "ef_construct": "200"})], "engine string, params map<string,string>")
    return verdicts.config_mismatch(rows, built, {"M": "m", "efSearch": "hnsw_ef", "efConstruction": "absent"}, ("single_node_hnsw",)).select("config", "mismatch")


UNCHECKED = Literal("u", "config VARCHAR, engine VARCHAR, constraint VARCHAR, outcome VARCHAR", [("a", "e1", "qps", "couldnt_check"), ("b", "e1", "qps", "couldnt_check"), ("b", "e2", "latency_p95", "couldnt_check"), ("b", None, "qps", "couldnt_check"), ("c", "e2", "qps", "meets"), ("a", "e1", "memory", "couldnt_check")])
INDEXES = Literal("i", "config VARCHAR, idx VARCHAR", [("a", "hnsw"), ("b", "ivf_pq"), ("c", "hnsw")])
COVERAGE = Literal("w", "engine VARCHAR, idx VARCHAR, status VARCHAR", [("e1", "hnsw", "builds"), ("e1", "ivf_pq", "cannot_build"), ("e2", "hnsw", "builds")])


@query(f"""WITH {UNCHECKED.sql()}, {INDEXES.sql()}, {COVERAGE.sql()}, e AS (SELECT u.*, i.idx, g.engine AS on_, coalesce(w.status, 'unresolved') AS status FROM u JOIN i USING (config) JOIN (SELECT DISTINCT engine FROM w) g ON u.engine IS NULL OR u.engine = g.engine LEFT JOIN w ON w.engine = g.engine AND w.idx = i.idx WHERE outcome = 'couldnt_check' AND "constraint" IN ('qps', 'latency_p95')),
n AS (SELECT config, engine, "constraint", CASE WHEN bool_or(status = 'builds') THEN 'not_verified' WHEN bool_or(status = 'unresolved') THEN 'coverage_unresolved' ELSE 'not_verifiable_here' END AS kind FROM e GROUP BY ALL)
SELECT u.config, u.engine, u."constraint", u.outcome, n.kind FROM u LEFT JOIN n ON n.config = u.config AND n.engine IS NOT DISTINCT FROM u.engine AND n."constraint" = u."constraint" """)
def unchecked_kinds(spark, sf):
    out = verdicts.unchecked_kinds(UNCHECKED.frame(spark), INDEXES.frame(spark).withColumnRenamed("idx", "index"), COVERAGE.frame(spark).withColumnRenamed("idx", "index"))
    return out.select("config", "engine", "constraint", "outcome", "kind")


WANTED = Literal("a", "family VARCHAR", [("x",), ("y",), ("z",)])
DROPPED = Literal("d", "family VARCHAR, at BIGINT, reason VARCHAR", [("y", 2, "later"), ("y", 1, "too small"), ("x", 1, "never mind")])


@query(f"WITH {WANTED.sql()}, {DROPPED.sql()} SELECT family, (SELECT count(*) FROM d WHERE d.family = a.family) AS dropped, coalesce((SELECT arg_min(reason, \"at\") FROM d WHERE d.family = a.family), 'no rows and no reason on record') AS reason, 'couldnt_check' AS outcome FROM a WHERE family <> 'x'")
def not_run_families(spark, sf):
    return verdicts.not_run(WANTED.frame(spark), WANTED.frame(spark).where("family = 'x'"), DROPPED.frame(spark))


PLANS = Literal("f", "family VARCHAR, amplification DOUBLE, measured_on VARCHAR, links BIGINT", [("single_node_hnsw", 1.0, None, 32), ("semantic_sharded", 3.4, None, 32), ("semantic_sharded_2", 3.4, None, 0)])


@query(f"""WITH {PLANS.sql()}, s AS (SELECT *, CASE WHEN family <> 'semantic_sharded' OR measured_on IS NOT NULL THEN CAST(round(10000000 * amplification) AS BIGINT) END AS stored FROM f)
SELECT family, stored AS stored_vectors, stored * (3072 + links * 8) AS memory_bytes, round(stored * (3072 + links * 8) / 1073741824.0, 9) AS memory_gib, CAST(greatest(1, ceil(stored * (3072 + links * 8) / 1073741824.0 / (64 * 0.7))) AS BIGINT) AS nodes, CASE WHEN stored IS NULL THEN 'couldnt_check' ELSE 'derived_from_declared' END AS kind FROM s WHERE stored IS NOT NULL
UNION ALL SELECT family, NULL, NULL, NULL, NULL, 'couldnt_check' FROM s WHERE stored IS NULL""")
def capacity_plan(spark, sf):
    out = verdicts.capacity(PLANS.frame(spark), {"size_now": 10_000_000, "dimension": 768}, 64.0)
    return out.withColumn("nodes", F.when(F.col("stored_vectors").isNotNull(), F.col("nodes"))).withColumn("memory_gib", F.round("memory_gib", 9))


MINE = Literal("mine", "field VARCHAR, value VARCHAR", [("topic", "law"), ("length", "long"), ("language", "en")])
FIXTURES = Literal("fx", "fixture VARCHAR, field VARCHAR, value VARCHAR", [("one", "topic", "law"), ("one", "length", "long"), ("two", "topic", "art"), ("two", "language", "en"), ("three", "size", "big")])


@query(f"WITH {MINE.sql()}, {FIXTURES.sql()}, w AS (SELECT fixture, fx.value = mine.value AS same, CASE field WHEN 'topic' THEN 3 WHEN 'length' THEN 1 ELSE 2 END AS w FROM fx JOIN mine USING (field)) SELECT fixture, round(sum(CASE WHEN same THEN w ELSE 0 END) / sum(w), 9) AS score, sum(CASE WHEN same THEN w ELSE 0 END) / sum(w) >= 0.7 AS analogous FROM w GROUP BY fixture")
def fixture_analogies(spark, sf):
    out = verdicts.analogy(MINE.frame(spark), FIXTURES.frame(spark), {"topic": 3.0, "length": 1.0, "language": 2.0})
    return out.withColumn("score", F.round("score", 9))


FACTS = [("code", "abc"), ("libraries", "l1"), ("seed", "7"), ("sample", "s"), ("ground_truth", "g"), ("query_subset", "q")]
ONE = Literal("one", "ingredient VARCHAR, value VARCHAR", FACTS)
TWO = Literal("two", "ingredient VARCHAR, value VARCHAR", [("code", "abc-dirty"), *FACTS[1:]])
STATES = f"{ONE.sql()}, {TWO.sql()}, st AS (SELECT ingredient, CASE WHEN one.value IS NULL OR two.value IS NULL OR (ingredient = 'code' AND (one.value LIKE '%-dirty' OR two.value LIKE '%-dirty')) THEN 'unknown' WHEN one.value = two.value THEN 'same' ELSE 'differs' END AS state FROM one FULL JOIN two USING (ingredient))"


@query(f"WITH {STATES} SELECT CASE WHEN bool_or(state = 'differs') THEN 'not_comparable' WHEN bool_or(state = 'unknown' AND ingredient IN ('code', 'seed')) THEN 'couldnt_check' ELSE 'comparable' END AS outcome, CAST(count(*) FILTER (state = 'same') AS BIGINT) AS same FROM st")
def run_comparability(spark, sf):
    return verdicts.comparable(ONE.frame(spark), TWO.frame(spark), ("code", "seed"))


@query(f"WITH {STATES}, k AS (SELECT unnest(['sample', 'ground_truth', 'query_subset', 'libraries']) AS ingredient, unnest([true, true, true, false]) AS data), j AS (SELECT data, coalesce(state, 'unknown') AS state FROM k LEFT JOIN st USING (ingredient)), r AS (SELECT CASE WHEN bool_or(state = 'differs' AND data) THEN 'other data' WHEN bool_or(state = 'differs') THEN 'other means' WHEN bool_or(state = 'unknown') THEN 'not on record' ELSE 'same data, same means' END AS reason FROM j) SELECT CASE WHEN reason LIKE 'other%' THEN 'not_comparable' WHEN reason = 'not on record' THEN 'couldnt_check' ELSE 'comparable' END AS outcome, reason FROM r")
def table_sharing(spark, sf):
    return verdicts.share_a_table(ONE.frame(spark), TWO.frame(spark), ("libraries",))


BRIDGED = Literal("br", "row BIGINT, sample VARCHAR, ground_truth VARCHAR, query_subset VARCHAR", [(1, "s", "g", "q"), (2, "s", "g", "q"), (3, "s", "h", "q"), (4, "s", "g", None)])


@query(f"WITH {BRIDGED.sql()} SELECT \"row\", CASE WHEN sample <> 's' OR ground_truth <> 'g' OR query_subset <> 'q' THEN 'not_comparable' WHEN sample IS NULL OR ground_truth IS NULL OR query_subset IS NULL THEN 'couldnt_check' ELSE 'comparable' END AS outcome FROM br")
def bridge_rows(spark, sf):
    return verdicts.assembled(BRIDGED.frame(spark)).select("row", "outcome")


ASKED_MEASURES = Literal("am", "measure VARCHAR", [("drift",), ("recall_at_10",), ("relevance",), ("vibes",)])


@query(f"WITH {ASKED_MEASURES.sql()} SELECT measure, CASE measure WHEN 'drift' THEN 'comparable' WHEN 'recall_at_10' THEN 'per_model' WHEN 'relevance' THEN 'not_measurable' ELSE 'unclassified' END AS register, CASE measure WHEN 'drift' THEN 'compared' ELSE 'refused' END AS outcome FROM am")
def model_registers(spark, sf):
    return verdicts.registers(ASKED_MEASURES.frame(spark))


MODELS = Literal("mo", "model VARCHAR, dimension BIGINT, fraction DOUBLE", [("small", 384, 0.01), ("base", 768, 0.04), ("cut", 768, 0.20), ("odd", 1024, None)])


@query(f"WITH {MODELS.sql()} SELECT model, fraction, fraction - (SELECT min(fraction) FROM mo) AS above_lowest, CASE WHEN fraction IS NULL THEN 'couldnt_check' WHEN fraction - (SELECT min(fraction) FROM mo) > 0.05 THEN 'confounded' ELSE 'clear' END AS outcome, dimension * 4 AS bytes, round(dimension / 384, 9) AS times FROM mo")
def model_confounds(spark, sf):
    rows = MODELS.frame(spark)
    return verdicts.truncation_confound(rows.select("model", "fraction")).join(verdicts.by_dimension(rows).select("model", "bytes", F.round("times", 9).alias("times")), "model")


LISTED = Literal("li", "name VARCHAR, sha256 VARCHAR", [("a", "1"), ("b", "2"), ("c", "3")])
FILES = Literal("fi", "name VARCHAR, sha256 VARCHAR", [("a", "1"), ("b", "9"), ("d", "4")])


@query(f"WITH {LISTED.sql()}, {FILES.sql()}, o AS (SELECT name, CASE WHEN li.sha256 IS NULL THEN 'unlisted' WHEN fi.sha256 IS NULL THEN 'couldnt_check' WHEN li.sha256 = fi.sha256 THEN 'verified' ELSE 'contradicted' END AS outcome FROM li FULL JOIN fi USING (name)) SELECT name, CASE WHEN outcome = 'verified' THEN 'couldnt_check' ELSE outcome END AS outcome FROM o")
def fixture_digests(spark, sf):
    """Outside the pinned environment."""
    return verdicts.downgraded(verdicts.digest_rows(LISTED.frame(spark), FILES.frame(spark)), True)


HISTORY = Literal("h", "at BIGINT, check VARCHAR, dataset VARCHAR, engine VARCHAR, config VARCHAR, measured DOUBLE, reference DOUBLE, tolerance DOUBLE, scope VARCHAR", [
    (1, "curve", "d", "e", "c", 0.9, 0.95, 0.01, "blocking"), (2, "curve", "d", "e", "c", 0.94, 0.95, 0.02, "advisory"), (3, "engine", "d", "e", "c", 0.9, 0.9, None, None), (4, "engine", "d", "f", "c", 0.9, 0.95, 0.01, None), (5, "engine", "d", "f", "k", None, 0.95, 0.01, "blocking"),
])
JUDGED = f"""{HISTORY.sql()}, j AS (SELECT "at", "check", dataset, engine, config, round(measured - reference, 9) AS deviation, CASE WHEN measured - reference IS NULL OR tolerance IS NULL THEN 'couldnt_check' WHEN abs(round(measured - reference, 9)) <= tolerance THEN 'verified' ELSE 'contradicted' END AS outcome, coalesce(scope, 'blocking') AS scope FROM h)"""


@query(f'WITH {JUDGED} SELECT "at", engine, config, deviation, outcome, scope FROM j QUALIFY row_number() OVER (PARTITION BY "check", dataset, engine, config ORDER BY "at" DESC) = 1')
def calibration_lines(spark, sf):
    return verdicts.history_state(HISTORY.frame(spark)).select("at", "engine", "config", "deviation", "outcome", "scope")


@query(f"WITH {JUDGED} SELECT engine, \"at\", outcome FROM j WHERE scope = 'blocking' QUALIFY row_number() OVER (PARTITION BY engine ORDER BY \"at\" DESC) = 1")
def engine_calibrations(spark, sf):
    return verdicts.engine_calibration(HISTORY.frame(spark)).select("engine", "at", "outcome")


CURVE = Literal("cu", "ef BIGINT, recall DOUBLE, published DOUBLE", [(10, 0.43, 0.37), (20, 0.56, 0.50), (40, 0.62, 0.61), (80, 0.75, None)])


@query(f"WITH {CURVE.sql()}, o AS (SELECT *, recall - published AS offs FROM cu) SELECT ef, round(offs, 9) AS offset, round(offs - (SELECT avg(offs) FROM o), 9) AS residual, CASE WHEN offs IS NULL THEN 'couldnt_check' WHEN abs(offs) <= 0.05 THEN 'verified' ELSE 'contradicted' END AS outcome FROM o")
def calibration_curve(spark, sf):
    rows = CURVE.frame(spark)
    return verdicts.calibration_curve(rows.select("ef", "recall"), rows.where("published is not null").select("ef", F.col("published").alias("recall")), 0.05).select("ef", "offset", "residual", "outcome")


EXPECTED = Literal("pr", "at BIGINT, kind VARCHAR, metric VARCHAR, before DOUBLE, after DOUBLE, direction VARCHAR, threshold DOUBLE, tolerance DOUBLE", [
    (1, "expects", "recall", 0.5, 0.7, "rises", 0.1, 0.01), (2, "expects", "loss", 0.5, 0.45, "falls", 0.1, 0.01), (3, "side_effect", "storage", 2.0, 4.0, "at_or_below", 3.5, 0.01), (4, "side_effect", "ceiling", 0.9, 0.95, "at_or_above", 0.9, 0.01), (5, "expects", "fanout", None, 2.0, "rises", 0.1, 0.01),
])
SETTLED = f"""{EXPECTED.sql()}, ofs AS (SELECT *, round(CASE direction WHEN 'rises' THEN after - before WHEN 'falls' THEN before - after ELSE after END - threshold, 6) AS off FROM pr),
se AS (SELECT *, CASE WHEN off IS NULL OR abs(off) < tolerance THEN 'couldnt_check' WHEN direction = 'at_or_below' AND off < 0 OR direction <> 'at_or_below' AND off > 0 THEN 'held' ELSE 'did_not_hold' END AS outcome FROM ofs)"""


@query(f"WITH {SETTLED} SELECT \"at\", metric, outcome, CAST(row_number() OVER (ORDER BY CASE WHEN outcome = 'did_not_hold' AND kind = 'side_effect' THEN 0 WHEN outcome = 'did_not_hold' THEN 1 WHEN kind = 'expects' THEN 2 ELSE 3 END, \"at\") AS INT) AS place FROM se")
def card_rows(spark, sf):
    return verdicts.card_order(verdicts.predictions(EXPECTED.frame(spark))).select("at", "metric", "outcome", "place")


@query(f"WITH {SETTLED} SELECT CASE WHEN bool_or(outcome = 'did_not_hold') THEN 'did_not_hold' WHEN bool_or(outcome = 'couldnt_check') THEN 'couldnt_check' ELSE 'held' END AS outcome FROM se UNION ALL SELECT 'couldnt_check'")
def whole_predictions(spark, sf):
    rows = EXPECTED.frame(spark)
    return verdicts.judged_prediction(rows, "d1", "d1", 7, 7).unionByName(verdicts.judged_prediction(rows, "d2", "d1", 7, 7)).select("outcome")


CARDS = Literal("ca", "card VARCHAR, path VARCHAR, value VARCHAR", [("x", "corpus.name", "n"), ("x", "corpus.model", None), ("y", "corpus.name", None), ("y", "seed", "1"), ("z", "corpus.name", "n"), ("z", "corpus.model", "m"), ("z", "seed", "2")])
PATHS = Literal("pa", "path VARCHAR", [("corpus.name",), ("corpus.model",), ("seed",)])


@query(f"WITH {CARDS.sql()}, {PATHS.sql()}, w AS (SELECT card, path FROM (SELECT DISTINCT card FROM ca), pa), m AS (SELECT card, path FROM w WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.card = w.card AND ca.path = w.path AND (ca.value IS NOT NULL OR ca.path = 'corpus.model'))) SELECT card, string_agg(path, ',' ORDER BY path) AS missing FROM m GROUP BY card")
def card_fields(spark, sf):
    return verdicts.missing_fields(CARDS.frame(spark), PATHS.frame(spark), ("corpus.model",))


SUBMITTED = Literal("su", "card VARCHAR, run BIGINT, published BIGINT, withheld BOOLEAN, prediction_digest VARCHAR, cited BOOLEAN, comparability VARCHAR", [
    ("a", 9, 3, False, "d", True, "comparable"), ("b", 9, None, False, "d", True, "comparable"), ("c", None, None, True, "", False, "couldnt_check"), ("d", 1, 1, None, "d", False, "not_comparable"),
])


@query(f"""WITH {SUBMITTED.sql()}, r AS (SELECT card, concat_ws(',', CASE WHEN NOT coalesce(withheld, false) AND (run IS NULL OR published IS NULL) THEN 'denominator' END, CASE WHEN coalesce(prediction_digest, '') = '' THEN 'prediction.digest' WHEN NOT coalesce(cited, false) THEN 'prediction.cited_by_run' END, CASE WHEN coalesce(comparability, '') NOT IN ('comparable', 'couldnt_check') THEN 'comparability' END) AS reasons FROM su)
SELECT card, reasons, CASE WHEN reasons = '' THEN 'publishable' ELSE 'refused' END AS outcome FROM r""")
def card_refusals(spark, sf):
    return verdicts.card_refusals(SUBMITTED.frame(spark))


RUNS = Literal("ru", "run VARCHAR", [("r1",), ("r2",), ("r3",)])
OUTCOMES = Literal("oc", "run VARCHAR, outcome VARCHAR", [("r1", "meets"), ("r1", "meets"), ("r1", "fails"), ("r2", "couldnt_check")])


@query(f"WITH {RUNS.sql()}, {OUTCOMES.sql()}, n AS (SELECT run, count(*) FILTER (outcome = 'meets') AS meets, count(*) FILTER (outcome = 'fails') AS fails, count(*) FILTER (outcome = 'couldnt_check') AS couldnt_check FROM oc GROUP BY run) SELECT run, CAST(meets AS BIGINT) AS meets, CAST(fails AS BIGINT) AS fails, CAST(couldnt_check AS BIGINT) AS couldnt_check, meets IS NOT NULL AS reported FROM ru LEFT JOIN n USING (run)")
def run_list(spark, sf):
    return verdicts.run_list(RUNS.frame(spark), OUTCOMES.frame(spark))


CLAIMS = Literal("cl", "claim VARCHAR, quantifier VARCHAR, scope VARCHAR, holds VARCHAR, constraint VARCHAR, asserts VARCHAR, rule VARCHAR", [
    ("fine", "universal", "a,b", "a,b", "recall", "meets", "any"), ("false", "universal", "a,c", "a", "recall", "meets", "any"), ("outside", "existential", "a", "a,d", "recall", None, "any"), ("empty", "existential", "c", "", "recall", None, "any"), ("everything", "existential", "a,b", "a,b", None, "meets", "all"),
])
CITES = Literal("ci", "claim VARCHAR, member VARCHAR, value DOUBLE, outcome VARCHAR", [("fine", "a", 0.9, "meets"), ("fine", "b", 0.8, "meets"), ("false", "a", 0.5, "meets"), ("outside", "a", 0.9, "fails"), ("empty", "c", 0.1, "fails"), ("everything", "a", None, None), ("everything", "b", None, None)])
FOUND = Literal("fo", "member VARCHAR, constraint VARCHAR, value DOUBLE, outcome VARCHAR", [("a", "recall", 0.9, "meets"), ("b", "recall", 0.8, "meets"), ("c", "recall", 0.1, "fails"), ("a", "storage", 1.0, "meets"), ("b", "storage", 9.0, "fails")])


@query(f"""WITH {CLAIMS.sql()}, {CITES.sql()}, {FOUND.sql()}, s AS (SELECT claim, unnest(string_split(scope, ',')) AS member FROM cl), h AS (SELECT claim, member FROM (SELECT claim, unnest(string_split(holds, ',')) AS member FROM cl) WHERE member <> ''),
bad AS (SELECT claim, member, 'holds outside its scope' AS problem FROM h ANTI JOIN s USING (claim, member) UNION ALL SELECT claim, member, 'isn''t cited' FROM s ANTI JOIN ci USING (claim, member)
UNION ALL SELECT claim, member, 'a universal claim doesn''t hold here' FROM s JOIN cl USING (claim) ANTI JOIN h USING (claim, member) WHERE quantifier = 'universal'
UNION ALL SELECT claim, NULL, 'an existential claim holds for nobody' FROM cl ANTI JOIN h USING (claim) WHERE quantifier = 'existential'
UNION ALL SELECT ci.claim, ci.member, 'cites another value than the row has' FROM ci JOIN cl USING (claim) JOIN fo ON fo.member = ci.member AND fo."constraint" = cl."constraint" WHERE abs(ci.value - fo.value) > 1e-9
UNION ALL SELECT ci.claim, ci.member, 'cites another outcome than the row has' FROM ci JOIN cl USING (claim) JOIN fo ON fo.member = ci.member AND fo."constraint" = cl."constraint" WHERE ci.outcome <> fo.outcome),
f AS (SELECT s.claim, s.member, first(cl.rule) AS rule, bool_or(fo.outcome = asserts) AS som, bool_and(fo.outcome = asserts) AS evr FROM s JOIN cl USING (claim) JOIN fo ON fo.member = s.member AND (cl."constraint" IS NULL OR cl."constraint" = fo."constraint") WHERE asserts IS NOT NULL GROUP BY ALL)
SELECT * FROM bad UNION ALL SELECT f.claim, f.member, 'the rows say otherwise' FROM f LEFT JOIN h USING (claim, member) WHERE (h.member IS NOT NULL) <> CASE WHEN rule = 'all' THEN evr ELSE som END""".replace("h.member IS NOT NULL", "EXISTS (SELECT 1 FROM h WHERE h.claim = f.claim AND h.member = f.member)").replace(" LEFT JOIN h USING (claim, member) WHERE (EXISTS", " WHERE (EXISTS"))
def claim_problems(spark, sf):
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    claims = CLAIMS.frame(spark).withColumn("scope", listed("scope")).withColumn("holds_for", listed("holds"))
    return verdicts.claim_problems(claims, CITES.frame(spark), FOUND.frame(spark))


DERIVED = Literal("de", "claim VARCHAR, op VARCHAR, left DOUBLE, right DOUBLE, value DOUBLE", [("a", "difference", 0.9, 0.7, 0.2), ("b", "difference", 0.9, 0.7, 0.3), ("c", "ratio", 1.0, 0.0, 1.0), ("d", "ratio", 3.0, 2.0, 1.5), ("e", "sum", 1.0, 2.0, 3.0)])


@query(f'WITH {DERIVED.sql()}, r AS (SELECT claim, op, value, CASE op WHEN \'difference\' THEN "left" - "right" WHEN \'ratio\' THEN "left" / nullif("right", 0) END AS again FROM de) SELECT claim FROM r WHERE again IS NULL OR abs(value - again) > 1e-6')
def derived_claims(spark, sf):
    return verdicts.derived_problems(DERIVED.frame(spark)).select("claim")


JOBS = Literal("jo", "job VARCHAR, at BIGINT, state VARCHAR", [("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "done"), ("b", 1, "queued"), ("b", 2, "refused"), ("c", 1, "queued"), ("c", 2, "done"), ("d", 1, "running"), ("e", 1, "queued"), ("e", 2, "cancelled"), ("e", 3, "running")])


@query(f"WITH {JOBS.sql()}, l AS (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY \"at\") AS before FROM jo) SELECT job, \"at\", state FROM l WHERE NOT (before IS NULL AND state = 'queued' OR before = 'queued' AND state IN ('running', 'refused', 'cancelled') OR before = 'running' AND state IN ('done', 'failed', 'refused', 'cancelled')) OR (before IS NULL AND state <> 'queued')")
def illegal_job_steps(spark, sf):
    return verdicts.illegal_steps(JOBS.frame(spark)).select("job", "at", "state")


PLANNED = verdicts.plan({"one": {"a": [1, 2]}, "two": {"b": [1, 2, 3], "c": [0]}}, 4, [("two", {"b": 3, "c": 0})])


@query("SELECT * FROM (VALUES ('one', 'one[a=1]'), ('one', 'one[a=2]'), ('two', 'two[b=3,c=0]'), ('two', 'two[b=1,c=0]')) t(family, config)")
def sweep_plan(spark, sf):
    return spark.createDataFrame([(f, families.label_of(f, c)) for f, c in PLANNED[0]], "family string, config string")
