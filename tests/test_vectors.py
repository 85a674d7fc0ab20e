import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import citations, engine, families, knn, measures, metrics, regions, sampling, state, verdicts, views
from cairn.operators.duplicates import lsh_recall
from cairn.operators.vectors import normalized, usable


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(0).standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, e array<double>").repartition(5).cache()


def queries(base):
    return base.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "e")


def test_exact_neighbours_match_numpy(points):
    x, base = points
    got = {}
    for r in knn.exact(base, queries(base), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q, ranks in got.items():
        s = np.round(x[q] @ x.T, 9)
        assert [ranks[i] for i in range(1, 6)] == np.lexsort((np.arange(400), -s))[:5].tolist()


def test_no_queries(spark, points):
    assert knn.exact(points[1], queries(points[1]).limit(0), 5).count() == 0


def test_shards_find_what_one_index_finds(points):
    _, base = points
    one = {(r.query_id, r.rank): r.vec_id for r in knn.exact(base, queries(base), 10).collect()}
    many = {(r.query_id, r.rank): r.vec_id for r in families.hash_search(base, queries(base), shards=3, k=10).collect()}
    assert one == many


@pytest.mark.parametrize("search", ["hnsw", "ivf", "pq"])
def test_index_recall(points, search):
    _, base = points
    q = queries(base)
    found = {
        "hnsw": lambda: families.hnsw_search(base, q, links=12, ef_build=64, ef=64, shards=2, k=10),
        "ivf": lambda: families.ivf_search(base, q, nlist=8, nprobe=7, k=10),
        "pq": lambda: families.ivf_pq_search(base, q, nlist=4, nprobe=4, m=8, nbits=4, k=10, rerank=10),
    }[search]()
    assert metrics.recall(found, knn.exact(base, q, 10), 10).first()[0] >= 0.9


@pytest.mark.parametrize("name", ["ivf_search", "ivf_pq_search", "hnsw_search"])
def test_recall_of_the_registered_indexes(spark, name):
    from cairn.plans import catalog, geometry_queries

    sf = "/root/testdata/sf0.01"
    found = catalog.QUERIES[name](spark, sf)
    assert metrics.recall(found, geometry_queries.truth(geometry_queries.vectors(spark, sf), 10), 10).first()[0] >= 0.9


def test_queries_in_blocks(points, monkeypatch):
    from cairn.operators import vectors

    _, base = points
    want = sorted(map(str, knn.exact(base, queries(base), 5).collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 16 * 8 * 3)
    assert sorted(map(str, knn.exact(base, queries(base), 5).collect())) == want


def test_every_shard_answers_to_its_depth(points):
    x, base = points
    got = families.hash_answers(base, queries(base), shards=3, k=10).collect()
    shard = {r.vec_id: r.shard for r in base.select("vec_id", regions.hash_shard(F.col("vec_id"), 3).alias("shard")).collect()}
    assert {(r.query_id, r.shard): 0 for r in got}.keys() == {(q, s) for q in range(0, 400, 40) for s in range(3)}
    for q in range(0, 400, 40):
        for s in range(3):
            ids = np.array([i for i in range(400) if shard[i] == s])
            score = np.round(x[q] @ x[ids].T, 9)
            assert {r.vec_id for r in got if (r.query_id, r.shard) == (q, s)} == set(ids[np.lexsort((ids, -score))[:30]].tolist())


def test_losses_sum_and_reranking_recovers_the_order(points):
    _, base = points
    q, k = queries(base), 10
    cents = regions.lloyd(base, 8, 5, 0)
    placed, routes = regions.placed(base, cents, 0.1), regions.distances(q, cents, 2, id_="query_id")
    true = knn.exact(base, q, k)
    rough = knn.ranked(families.semantic_search(placed, routes, q, 40).withColumn("score", F.round("score", 1)).drop("rank"), 40)
    first = rough.where(F.col("rank") <= k)
    d = metrics.decomposition(routes.join(placed.select("vec_id", "region"), "region"), rough, first, true, k).first()
    assert d.routing_loss + d.candidate_loss + d.ordering_loss == pytest.approx(1 - d.recall_before_rerank)
    again = metrics.recall(knn.rescored(rough, base, q, k), true, k).first()[0]
    assert again == pytest.approx(1 - d.routing_loss - d.candidate_loss) and again >= d.recall_before_rerank


def test_indexes_refuse_too_few_rows(points):
    _, base = points
    with pytest.raises(families.IndexTooSmall):
        families.ivf_search(base, queries(base), nlist=1000, nprobe=1, k=5)
    with pytest.raises(families.IndexTooSmall):
        families.ivf_pq_search(base, queries(base), nlist=4, nprobe=1, m=5, nbits=4, k=5)


def test_states_keep_their_contract_and_survive_a_file(spark, points, tmp_path):
    _, base = points
    cents = regions.lloyd(base, 6, 2, 0)
    q = queries(base)
    s = state.emitted(base, q, cents, knn.exact(base, q, 5), eps=0.3, probe=2, depth=30)
    s = state.with_places(s, base.select("vec_id", F.get("e", F.lit(0)).alias("x"), F.get("e", F.lit(1)).alias("y")))
    amplification = s.copies.count() / s.base.count()
    assert state.violations(s, amplification).count() == 0
    state.write(s, f"file://{tmp_path}/s")
    again = state.read(spark, f"file://{tmp_path}/s")
    assert state.violations(again, amplification).count() == 0 and again.eps == 0.3
    assert {r.rule for r in state.violations(again, amplification + 1).collect()} == {"copies give the footprint's amplification"}
    again.spots = None
    assert "queries have places only where vectors have" in {r.rule for r in state.violations(again).collect()}
    again.near = None
    assert "the nearest regions are stated" in {r.rule for r in state.violations(again).collect()}


def test_views_show_recall_at_simulated_epsilons_only(points):
    _, base = points
    q = queries(base)
    cents = regions.lloyd(base, 6, 2, 0)
    true = knn.exact(base, q, 5)
    s = state.emitted(base, q, cents, true, eps=0.2, probe=2, depth=30)
    index = views.query_index(s, 5)
    found = metrics.recall(views.top(s, 5).withColumn("rank", F.col("place")), true, 5).first()[0]
    assert index.agg(F.sum("hits")).first()[0] / (5 * q.count()) == pytest.approx(found)
    assert "hits" not in views.query_index(s, 5, 0.4).columns and "found" not in views.query_trace(s, 0, 5, 0.4).columns
    assert views.query_trace(s, 0, 5).count() == 5
    with pytest.raises(ValueError):
        views.query_index(s, 5, 0.4, (0.4,))
    with pytest.raises(ValueError):
        views.query_trace(s, 1)
    wider = views.ground(s, 0.4, 5).first()
    want = regions.placed(base, cents, 0.4).groupBy("vec_id").count().agg(F.avg("count")).first()[0]
    assert wider.amplification == pytest.approx(want) and wider.vectors == 400
    assert views.copies_histogram(s).agg(F.sum("vectors")).first()[0] == 400


def test_kmeans_is_lloyd(points):
    x, base = points
    got = {r.region: (r.centroid, r["size"]) for r in regions.lloyd(base, 5, 4, 0).collect()}
    start = [r.vec_id for r in base.orderBy(F.md5(F.concat(F.lit("0:"), F.col("vec_id").cast("string")).cast("binary"))).limit(5).collect()]
    now = x[start]
    for _ in range(4):
        home = np.round(((x[:, None] - now[None]) ** 2).sum(2) ** 0.5, 9).argmin(1)
        now = np.array([x[home == r].mean(0) if (home == r).any() else now[r] for r in range(5)])
    for r in range(5):
        assert got[r][0] == pytest.approx(now[r], abs=1e-6)


def test_an_engine_keeps_the_last_write(spark, tmp_path, points):
    _, base = points
    e = engine.Engine(spark, f"file://{tmp_path}")
    e.create("cairn_a", 16)
    assert e.search("cairn_a", queries(base), 3).count() == 0 and e.upsert("cairn_a", base) == 400
    moved = base.where("vec_id = 7").withColumn("e", F.transform("e", lambda x: -x))
    e.upsert("cairn_a", moved)
    about = e.describe("cairn_a")
    assert (about["vectors"], about["writes"]) == (400, 2)
    assert [r.vec_id for r in e.scroll("cairn_a", 2).collect()] == [0, 1]
    asked = moved.select(F.col("vec_id").alias("query_id"), "e")
    assert e.search("cairn_a", asked, 1).first().vec_id == 7
    for bad in (lambda: e.create("other", 3), lambda: e.create("cairn_a", 3), lambda: e.create("cairn_b", 3, "odd"), lambda: e.upsert("cairn_a", base.limit(1).withColumn("e", F.slice("e", 1, 3)))):
        with pytest.raises(ValueError):
            bad()
    e.delete("cairn_a")
    assert not e.exists("cairn_a")
    with pytest.raises(KeyError):
        e.describe("cairn_a")


def test_sweeps_drop_what_the_rows_cannot_fill(points):
    _, base = points
    q = queries(base)
    rows, dropped = families.sweep(base, q, knn.exact(base, q, 10), [("single_node", {}), ("semantic_sharded", {"centroids": 4, "eps": 0.0, "probe": 1}), ("semantic_sharded", {"centroids": 9999, "eps": 0.0, "probe": 1})], rounds=2, ks=(1, 10))
    got = {r.family: r for r in rows.collect()}
    assert got["single_node"].recall_at_10 == got["single_node"].recall_at_1 == got["single_node"].inv_ratio == 1.0 and len(dropped) == 1
    one = got["semantic_sharded"]
    assert one.recall_at_1 == 1.0 and one.recall_at_10 == pytest.approx(one.ceiling) and one.ceiling < 1
    for bad in (("odd", {}), ("single_node", {"eps": 1})):
        with pytest.raises(ValueError):
            families.checked(*bad)


def test_vectors_without_structure(spark):
    rows = np.array([r.e for r in families.isotropic(spark, 500, 32).collect()])
    assert np.linalg.norm(rows, axis=1) == pytest.approx(np.ones(500)) and abs(rows.mean()) < 0.01


def test_shares_are_told_from_their_empty_end(spark):
    rows = spark.createDataFrame([(0.0373, 150_000), (0.0001, 20_000), (0.5, 6)], "share double, n long")
    assert [r.resolvable for r in measures.distinguishable(rows, 0.0).collect()] == [True, False, False]
    twin = spark.createDataFrame([(0.935, 200), (0.999, 2000)], "share double, n long")
    out = measures.distinguishable(twin, 1.0).collect()
    assert [r.resolvable for r in out] == [True, False] and out[0].sigma == pytest.approx(3.73, abs=0.01) and out[0].informative == 13


def test_grids_give_back_counts(spark):
    x = np.random.default_rng(3).exponential(size=2000) + 1
    rows = spark.createDataFrame([(float(v),) for v in x], "ratio double")
    grid = measures.ratio_grid(rows).cache()
    for t in (1.2, 2.0, 3.3):
        assert measures.count_from(grid, t).first()[0] == pytest.approx((x > t).mean(), abs=0.005)
    assert [measures.count_from(grid, t).first()[0] for t in (0.5, 99.0)] == [1.0, 0.0]
    flat = measures.ratio_grid(spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 50, "ratio double"))
    assert measures.percentile_of(flat, 1.5).first()[0] == pytest.approx(np.interp(1.5, *zip(*[(r.ratio, r.pct) for r in flat.orderBy("pct").collect()], strict=True)))


def test_drift_needs_both_sides(spark):
    truth = spark.createDataFrame([(1, 10, 1), (2, 11, 1)], "query_id long, vec_id long, rank int")
    homes = spark.createDataFrame([(10, 0), (11, 1)], "vec_id long, region long")
    routes = spark.createDataFrame([(1, 0), (2, 0)], "query_id long, region long")
    base_times = spark.createDataFrame([(10, "2019"), (11, "2021")], "vec_id long, at string")
    both = spark.createDataFrame([(1, "2018"), (2, "2022")], "query_id long, at string")
    r = measures.drift(truth, homes, routes, both, "2020", base_times).first()
    assert (r.outcome, r.before, r.after, r.n_before, r.n_after) == ("measured", 1.0, 0.0, 1, 1)
    assert measures.drift(truth, homes, routes, both.withColumn("at", F.lit("2022")), "2020", base_times).first().outcome == "couldnt_check"
    assert measures.drift(truth, homes, routes, both, "2000", base_times).first().reason == "the cutoff leaves one side of the rows empty"
    assert measures.cutoff_of(base_times, None).first()[0] == "2021"


def test_thresholds_of_definitions(spark):
    pairs = spark.createDataFrame([(1, 0, 1.0, 1.19), (2, 0, 1.0, 1.20), (3, 0, 1.0, 1.21)], "vec_id long, region long, d1 double, d2 double")
    assert measures.crispness(pairs).first().crispness == pytest.approx(1 / 3)
    near = spark.createDataFrame([(1, 0, 1.0, 1.10), (2, 0, 1.0, 1.11)], "vec_id long, region long, d1 double, d2 double")
    assert measures.ambiguity(near).first().ambiguous_rate == 0.5


def test_percentile_is_the_inverse_of_the_grid(spark):
    rows = spark.range(1, 1002).select((1 + F.col("id") / 1000).alias("ratio"))
    assert measures.percentile_of(measures.ratio_grid(rows), 1.5).first()[0] == pytest.approx(49.9, abs=0.2)
    assert measures.percentile_of(measures.ratio_grid(rows), 9.0).first()[0] == 100.0


def test_intrinsic_dimension_of_a_plane(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 3)) @ rng.standard_normal((3, 24))
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, e array<double>")
    near = knn.exact(base, base.withColumnRenamed("vec_id", "query_id"), 3, metric="l2").where("query_id <> vec_id")
    near = knn.ranked(near.drop("rank"), 2).withColumn("distance", -F.col("score"))
    assert 2.3 < measures.two_nn(near).first().lid < 4


def test_usable_and_normalized(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [float("inf"), 1.0])], "vec_id long, embedding array<float>")
    rows = {r.vec_id: list(r.e) for r in usable(df).select("vec_id", normalized(F.col("embedding")).alias("e")).collect()}
    assert set(rows) == {1, 6} and rows[1] == pytest.approx([0.6, 0.8]) and rows[6] == [0.0, 0.0]


def test_quotas_sum_and_break_ties(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)] * 5, "s string")
    assert {r.s: r.quota for r in sampling.quotas(df, "s", 10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_outcomes_are_never_rounded_up(spark):
    rows = spark.createDataFrame([("x", "e1", 0.95), ("y", "e1", 0.5)], "config string, engine string, recall double")
    v = verdicts.judged(rows, [("recall", "recall", ">=", 0.9), ("memory", "gb", "<=", 1.0)])
    got = {r.config: r.outcome for r in verdicts.overall(rows, verdicts.over_engines(v)).collect()}
    assert got == {"x": "couldnt_check", "y": "fails"}


def test_ladder_stops_at_the_first_bad_rung(spark):
    rungs = spark.createDataFrame([(1, 10.0, 0.0, 5.0), (2, 20.0, 0.0, 6.0), (3, 30.0, 0.2, 6.0), (4, 40.0, 0.0, 6.0)], "rung int, qps double, error_rate double, p99 double")
    r = metrics.ladder(rungs).first()
    assert (r.ceiling_qps, r.degraded_at) == (20.0, 3)


def test_banding_is_all_but_exact_from_seven_tenths():
    assert lsh_recall(0.7) > 0.999 > lsh_recall(0.5)


def test_all_steps_of_the_ratio_grid(spark):
    x = np.random.default_rng(5).exponential(size=777) + 1
    rows = spark.createDataFrame([(float(v),) for v in x] + [(float("inf"),)] * 3, "ratio double")
    grid = measures.ratio_grid(rows).orderBy("pct").collect()
    assert [r.pct for r in grid] == [i / 2 for i in range(201)]
    assert [r.ratio for r in grid] == pytest.approx(np.quantile(x, np.arange(201) / 200).tolist())
    assert {(r.n, r.n_infinite) for r in grid} == {(780, 3)}


def test_truth_is_kept(points, tmp_path):
    _, base = points
    q = queries(base)
    want = sorted(map(str, knn.exact(base, q, 4).collect()))
    for _ in range(2):
        assert sorted(map(str, knn.kept_truth(base, q, 4, f"file://{tmp_path}").collect())) == want
    assert knn.kept_truth(base, q.limit(3), 4, f"file://{tmp_path}").count() == 12


def test_policies_name_every_problem():
    fine = {"family": "semantic_sharded", "configuration": {"centroids": 8, "eps": 0.1, "probe": 1}, "changes": [{"param": "eps", "from": 0.1, "to": 0.2}]}
    assert families.policy_problems(fine) == []
    bad = {"family": "semantic_sharded", "configuration": {"centroids": 8, "odd": 1}, "changes": [{"param": "eps", "from": 0.1, "to": 0.1}, {"param": "eps"}], "scope": "all"}
    assert len(families.policy_problems(bad)) == 7
    assert "no family x" in families.policy_problems({"family": "x", "configuration": {}, "changes": []})


def test_citations_are_read_back():
    run = {"simulate.json": {"rows": [{"config": "a[M=32,eps=0.2]", "recall": 0.9}, {"config": "b", "recall": 0.5}]}, "verify.json": {"engines": [{"engine": "e", "load": {"qps": 7.0}}], "spread": {"min": 1.0, "max": 2.0}}}
    resolve = citations.resolve
    assert resolve("simulate.json:rows[a[M=32,eps=0.2]].recall", run).value == 0.9
    assert resolve("verify.json:load.qps", run, "e").value == 7.0 and resolve("simulate.json:rows.recall", run, "b").value == 0.5
    assert [resolve(s, run, pending=("report.json",)).kind for s in ("", "requirements:x", "simulate.json:rows[*].recall", "report.json:x", "gone.json:x", "simulate.json", "simulate.json:rows[z].recall")] == ["unresolved", "requirements", "every_option", "pending", "unresolved", "unresolved", "unresolved"]
    with pytest.raises(citations.Malformed):
        citations.steps("a[b")
    cites = [("simulate.json:rows[b].recall", 0.5, None), ("simulate.json:rows[b].recall", 0.6, None), ("verify.json:spread", 2.0, None), ("gone.json:x", 1, None)]
    assert [p for _, p in citations.disagreements(cites, run)] == ["holds 0.5", "holds it as max", "no gone.json"]


def test_footprints_of_codes():
    assert families.code_bytes(768) == 3072 and families.code_bytes(768, 16, 8) == 16 and families.code_bytes(64, 3, 3) == 2
    assert families.label_of("f", {"b": 1, "a": 2}) == "f[a=2,b=1]" and families.least_depth(10) == 30
