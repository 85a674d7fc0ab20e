"""Rules over rows of measured configurations, and over claims, predictions, cards and runs. An outcome is meets, fails or couldnt_check, never null, and has a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEETS, FAILS, UNKNOWN = "meets", "fails", "couldnt_check"


def outcome(value: Column, ok: Column) -> Column:
    return F.when(value.isNull(), UNKNOWN).when(ok, MEETS).otherwise(FAILS)


def judged(rows: DataFrame, constraints: list[tuple[str, str, str, float]]) -> DataFrame:
    """(config, engine, constraint, value, threshold, outcome, reason) for each row and (name, column, '>=' or '<=', threshold)."""
    structs = []
    for name, column, sign, threshold in constraints:
        value = F.col(column).cast("double") if column in rows.columns else F.lit(None).cast("double")
        ok = value >= threshold if sign == ">=" else value <= threshold
        reason = F.when(value.isNull(), F.lit(f"{column} wasn't measured; measure it")).otherwise(F.lit(f"{column} {sign} {threshold}"))
        structs.append(F.struct(F.lit(name).alias("constraint"), value.alias("value"), F.lit(float(threshold)).alias("threshold"), outcome(value, ok).alias("outcome"), reason.alias("reason")))
    return rows.select("config", "engine", F.explode(F.array(*structs)).alias("v")).select("config", "engine", "v.*")


def judged_runs(runs: DataFrame, cap: float, *by: str) -> DataFrame:
    """Several runs of a figure p95: all within the cap meet it, all beyond fail, else it can't be told."""
    out = F.when(F.max("p95").isNull(), UNKNOWN).when(F.max("p95") <= cap, MEETS).when(F.min("p95") > cap, FAILS).otherwise(UNKNOWN)
    return runs.groupBy(*by).agg(out.alias("outcome"), F.min("p95").alias("least"), F.max("p95").alias("most"))


def throughput(rows: DataFrame, wanted: float) -> DataFrame:
    """(…, achieved_qps, target_qps, duration, completed, errors) to an outcome. A throttled run (target_qps > 0) holds its offered rate without
    errors and with a shortfall of one query a second at most; a free run must reach `wanted`."""
    free = F.coalesce(F.col("target_qps"), F.lit(0.0)) <= 0
    short = F.col("target_qps") * F.col("duration") - F.col("completed")
    held = F.when(F.col("errors") > 0, FAILS).when(short <= F.col("duration"), MEETS).otherwise(FAILS)
    return rows.withColumn("outcome", F.when(F.col("achieved_qps").isNull(), UNKNOWN).when(free, F.when(F.col("achieved_qps") >= wanted, MEETS).otherwise(FAILS)).otherwise(held))


def latency(rows: DataFrame, measured: DataFrame, constraint: dict) -> DataFrame:
    """Rows (config) against measured latencies (config, engine, kind, environment, concurrency, p95: a row for each run), by a constraint
    {p95_ms, environment?, at_qps?, concurrency?}: (config, engine, outcome, value, reason).

    A constraint that names a rate or a concurrency is about latency under load (kind `load`), else about a single client. Other kinds,
    environments or concurrencies never stand in. All runs must keep the cap to meet it, all must break it to fail.
    """
    cap, kind = float(constraint["p95_ms"]), "load" if {"at_qps", "concurrency"} & set(constraint) else "single"
    found = rows.select("config").distinct().join(measured, "config", "left")
    wrong = F.when(F.col("p95").isNull(), "not verified").when(F.col("kind") != kind, f"not measured: {kind}")
    if "environment" in constraint:
        wrong = wrong.when(~F.col("environment").eqNullSafe(F.lit(constraint["environment"])), "measured in another environment")
    if kind == "load" and "concurrency" in constraint:
        wrong = wrong.when(~F.col("concurrency").eqNullSafe(F.lit(constraint["concurrency"])), "measured at another concurrency")
    usable = found.withColumn("wrong", wrong)
    of = usable.groupBy("config", "engine").agg(
        F.max(F.when(F.col("wrong").isNull(), F.col("p95"))).alias("most"), F.min(F.when(F.col("wrong").isNull(), F.col("p95"))).alias("least"), F.min("wrong").alias("wrong")
    )
    out = F.when(F.col("most").isNull(), UNKNOWN).when(F.col("most") <= cap, MEETS).when(F.col("least") > cap, FAILS).otherwise(UNKNOWN)
    value = F.when(F.col("outcome") == MEETS, F.col("most")).when(F.col("outcome") == FAILS, F.col("least"))
    why = F.when(F.col("most").isNull(), F.col("wrong")).when(F.col("outcome") == UNKNOWN, "the cap lies between the runs").otherwise(F.lit(f"against {cap} ms"))
    return of.withColumn("outcome", out).select("config", "engine", "outcome", value.alias("value"), why.alias("reason"))


def config_mismatch(rows: DataFrame, built: DataFrame, names: dict[str, str], families: tuple[str, ...]) -> DataFrame:
    """Rows (config, family, params map) against what an engine built (engine, params map): (config, engine, mismatch), null where the row is the one that was built.

    `names`: a parameter's name to the engine's; others aren't looked at, nor values that the engine doesn't report. A family that isn't
    among `families` can't be built as one index at all.
    """
    both = rows.select("config", "family", "params").join(F.broadcast(built.select("engine", F.col("params").alias("built"))))
    differs = F.lit(None).cast("string")
    parts = []
    for mine, theirs in sorted(names.items()):
        x, y = F.try_element_at("params", F.lit(mine)), F.try_element_at("built", F.lit(theirs))
        parts.append(F.when(x.try_cast("double") != y.try_cast("double"), F.concat(F.lit(f"{mine}="), x, F.lit(f", built {theirs}="), y)))
    if parts:
        differs = F.array_join(F.filter(F.array(*parts), lambda d: d.isNotNull()), "; ")
    other = ~F.col("family").isin(*families)
    return both.select("config", "engine", F.when(other, F.concat(F.lit("simulated as "), F.col("family"), F.lit(", never built"))).when(differs != "", differs).alias("mismatch"))


BUILDS, CANNOT = "builds", "cannot_build"


def unchecked_kinds(verdicts: DataFrame, families: DataFrame, coverage: DataFrame, engine_constraints: tuple[str, ...] = ("latency_p95", "qps")) -> DataFrame:
    """Adds kind and remedy to verdicts (config, engine, constraint, outcome) that couldn't be checked on an engine, by what engines can build:
    `families` (config, index), `coverage` (engine, index, status). A verdict without an engine goes by all of them."""
    asked = verdicts.join(families, "config", "left").where(F.col("constraint").isin(*engine_constraints) & (F.col("outcome") == UNKNOWN))
    known = coverage.select(F.col("engine").alias("__e"), "index", "status")
    engines = coverage.select(F.col("engine").alias("__e")).distinct()
    each = asked.join(F.broadcast(engines), F.col("engine").isNull() | (F.col("engine") == F.col("__e"))).join(known, ["__e", "index"], "left")
    state = F.max((F.col("status") == BUILDS).cast("int")), F.max((F.coalesce("status", F.lit("unresolved")) == "unresolved").cast("int"))
    kinds = each.groupBy("config", "engine", "constraint").agg(state[0].alias("can"), state[1].alias("open"), F.array_join(F.sort_array(F.collect_set("__e")), ", ").alias("on"))
    kinds = kinds.select(F.col("config").alias("__c"), F.col("engine").alias("__n"), F.col("constraint").alias("__k"), F.when(F.col("can") == 1, "not_verified").when(F.col("open") == 1, "coverage_unresolved").otherwise("not_verifiable_here").alias("kind"), "on")
    same = (F.col("config") == F.col("__c")) & F.col("engine").eqNullSafe(F.col("__n")) & (F.col("constraint") == F.col("__k"))
    out = verdicts.join(kinds, same, "left").drop("__c", "__n", "__k")
    unchecked = F.col("outcome") == UNKNOWN
    kind = F.when(unchecked & F.col("constraint").isin(*engine_constraints), F.coalesce("kind", F.lit("not_verified")))
    remedy = F.when(F.col("kind") == "not_verified", "verify this configuration").when(F.col("kind") == "coverage_unresolved", F.concat(F.lit("ask what it builds: "), F.col("on"))).when(F.col("kind") == "not_verifiable_here", F.concat(F.lit("another engine than "), F.col("on")))
    return out.withColumn("kind", kind).withColumn("remedy", remedy).drop("on")


def over_engines(verdicts: DataFrame) -> DataFrame:
    """One outcome for each constraint: any engine that meets it is enough; all must fail it to fail."""
    some = lambda o: F.max((F.col("outcome") == o).cast("int")) == 1
    all_fail = F.min((F.col("outcome") == FAILS).cast("int")) == 1
    return verdicts.groupBy("config", "constraint").agg(F.when(some(MEETS), MEETS).when(all_fail, FAILS).otherwise(UNKNOWN).alias("outcome"))


def overall(configs: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Any constraint failed fails a configuration; all must be met; none at all can't be checked."""
    agg = collapsed.groupBy("config").agg(F.max((F.col("outcome") == FAILS).cast("int")).alias("f"), F.min((F.col("outcome") == MEETS).cast("int")).alias("m"))
    return configs.select("config").distinct().join(agg, "config", "left").select("config", F.when(F.col("f") == 1, FAILS).when(F.col("m") == 1, MEETS).otherwise(UNKNOWN).alias("outcome"))


def engines_meeting(verdicts: DataFrame) -> DataFrame:
    """Engines of a configuration that fail nothing and meet something."""
    agg = verdicts.groupBy("config", "engine").agg(F.max((F.col("outcome") == FAILS).cast("int")).alias("f"), F.max((F.col("outcome") == MEETS).cast("int")).alias("m"))
    return agg.where("f = 0 AND m = 1").select("config", "engine")


def indistinguishable(rows: DataFrame, outcomes: DataFrame, within: float = 0.01) -> DataFrame:
    """Configurations that don't fail and whose recall differs by less than `within`: (config, others)."""
    ok = rows.join(outcomes.where(F.col("outcome") != FAILS), "config").select("config", "recall").distinct()
    # buckets as wide as the tolerance leave neighbours only to compare
    at = ok.withColumn("b", F.floor(F.col("recall") / within))
    other = at.select(F.col("config").alias("other"), F.col("recall").alias("r2"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    near = at.join(other, "b").where((F.col("config") != F.col("other")) & (F.abs(F.col("recall") - F.col("r2")) < within))
    return near.groupBy("config").agg(F.array_join(F.sort_array(F.collect_set(F.col("other").cast("string"))), ",").alias("others"))


def at_margin(verdicts: DataFrame, margin: float = 0.1) -> DataFrame:
    """Adds tight: a constraint that is met within a tenth of its threshold; recall from above, others from below."""
    v, t = F.col("value"), F.col("threshold")
    near = F.when(F.col("constraint") == "recall", v < t * (1 + margin)).otherwise(v > t * (1 - margin))
    return verdicts.withColumn("tight", F.coalesce((F.col("outcome") == MEETS) & (t != 0) & near, F.lit(False)))


def ranking(rows: DataFrame, outcomes: DataFrame, verdicts: DataFrame, margin: float = 0.1) -> DataFrame:
    """Configurations that meet everything (config, amplification, fanout): those with the fewest constraints at their margin first, then by
    storage, fan-out, name. The first is the one recommended; none is where there is none."""
    ok = rows.join(outcomes.where(F.col("outcome") == MEETS).select("config"), "config", "left_semi")
    margins = at_margin(verdicts, margin).groupBy("config").agg(F.sum(F.col("tight").cast("long")).alias("margins"))
    counted = ok.join(margins, "config", "left").withColumn("margins", F.coalesce("margins", F.lit(0)))
    order = Window.orderBy("margins", F.asc_nulls_last("amplification"), F.asc_nulls_last("fanout"), "config")  # a row for each configuration
    return counted.select("config", "margins", "amplification", "fanout", F.row_number().over(order).alias("place"))


def not_run(asked: DataFrame, ran: DataFrame, dropped: DataFrame) -> DataFrame:
    """Families asked for without a row, with how many of their configurations were dropped and the first reason."""
    first = dropped.groupBy("family").agg(F.min_by("reason", "at").alias("why"), F.count("*").alias("dropped"))
    out = asked.join(ran.select("family").distinct(), "family", "left_anti").join(first, "family", "left")
    return out.select("family", F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("why", F.lit("no rows and no reason on record")).alias("reason"), F.lit(UNKNOWN).alias("outcome"))


#: Hours of a month, usable share of a node's memory, and the band around an estimate.
HOURS, FILL, BAND = 730.0, 0.7, 0.25


def node_cost(needs: DataFrame, nodes: DataFrame, hours: float = HOURS, fill: float = FILL, band: float = BAND, most_gb: float | None = None) -> DataFrame:
    """(config, gb) over nodes (node, memory_gb, price): the cheapest node type with its count, and a band around its cost.

    `most_gb` leaves larger machines out, as long as any is left. Without a size nothing can be costed.
    """
    allowed = nodes
    if most_gb is not None:
        small = nodes.where(F.col("memory_gb") <= most_gb)
        allowed = small if small.limit(1).count() else nodes
    count = F.ceil(F.col("gb") / (F.col("memory_gb") * fill))
    priced = needs.where("gb is not null").join(F.broadcast(allowed)).withColumn("count", F.greatest(F.lit(1), count)).withColumn("cost", F.col("count") * F.col("price") * hours)
    best = priced.groupBy("config").agg(F.min_by(F.struct("node", "count", "cost"), F.struct("cost", "node")).alias("b"))
    best = needs.select("config").join(best, "config", "left")
    return best.select("config", "b.node", F.col("b.count").alias("nodes"), F.col("b.cost").alias("cost"), (F.col("b.cost") * (1 - band)).alias("low"), (F.col("b.cost") * (1 + band)).alias("high"))


def capacity(families: DataFrame, declared: dict, budget_gib: float | None = None, fill: float = FILL) -> DataFrame:
    """(family, amplification, measured_on, links) over a declared {size_now, dimension}: vectors stored, bytes, GiB and nodes. A verdict is never given:
    the input is declared. `semantic_sharded` copies vectors by how the corpus clusters; without an amplification measured on a like corpus (`measured_on`) it
    can't be told."""
    known = F.col("amplification").isNotNull() & ((F.col("family") != "semantic_sharded") | F.col("measured_on").isNotNull())
    stored = F.when(known, F.round(F.lit(declared["size_now"]) * F.col("amplification")).cast("long"))
    per = F.lit(declared["dimension"] * 4) + F.col("links") * 8
    out = families.withColumn("stored_vectors", stored).withColumn("memory_bytes", F.col("stored_vectors") * per).withColumn("memory_gib", F.col("memory_bytes") / F.lit(2.0**30))
    nodes = F.greatest(F.lit(1), F.ceil(F.col("memory_gib") / (budget_gib * fill))).cast("long") if budget_gib else F.lit(None).cast("long")
    return out.withColumn("nodes", nodes).withColumn("kind", F.when(known, "derived_from_declared").otherwise(UNKNOWN)).select("family", "stored_vectors", "memory_bytes", "memory_gib", "nodes", "kind")


def budget(costs: DataFrame, amount: float) -> DataFrame:
    """The cost's upper bound decides."""
    return costs.withColumn("outcome", outcome(F.col("high"), F.col("high") <= amount))


def analogy(mine: DataFrame, fixtures: DataFrame, weights: dict[str, float], floor: float = 0.7) -> DataFrame:
    """Long tables (field, value) and (fixture, field, value): weighted agreement over fields both state; under the floor is no analogy."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    both = fixtures.join(mine.withColumnRenamed("value", "wanted"), "field").withColumn("w", F.coalesce(F.try_element_at(weight, F.col("field")), F.lit(0.0)))
    score = both.groupBy("fixture").agg(F.try_divide(F.sum(F.when(F.col("value") == F.col("wanted"), F.col("w")).otherwise(0.0)), F.sum("w")).alias("score"))
    return score.withColumn("analogous", F.coalesce(F.col("score") >= floor, F.lit(False)))


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """Long tables (ingredient, value) of two runs to (ingredient, state): same, differs, or unknown where a side has none or a commit that isn't clean."""
    both = one.withColumnRenamed("value", "x").join(two.withColumnRenamed("value", "y"), "ingredient", "full")
    dirty = (F.col("ingredient") == "code") & (F.coalesce(F.col("x").endswith("-dirty"), F.lit(False)) | F.coalesce(F.col("y").endswith("-dirty"), F.lit(False)))
    return both.select("ingredient", F.when(F.col("x").isNull() | F.col("y").isNull() | dirty, "unknown").when(F.col("x") == F.col("y"), "same").otherwise("differs").alias("state"))


def comparable(one: DataFrame, two: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Any ingredient that differs bars comparison, a required unknown leaves it open; a required one that neither run has is unknown too."""
    spark = one.sparkSession
    rows = compared(one, two).join(F.broadcast(spark.createDataFrame([(r,) for r in required], "ingredient string").withColumn("required", F.lit(True))), "ingredient", "full")
    state = F.coalesce("state", F.lit("unknown"))
    open_ = (state == "unknown") & F.coalesce("required", F.lit(False))
    return rows.agg(F.when(F.max((state == "differs").cast("int")) == 1, "not_comparable").when(F.max(open_.cast("int")) == 1, UNKNOWN).otherwise("comparable").alias("outcome"), F.sum((state == "same").cast("long")).alias("same"))


#: What a row was measured against; rows may share a table only where all three agree.
MEASURED_AGAINST = ("sample", "ground_truth", "query_subset")


def share_a_table(one: DataFrame, two: DataFrame, measuring: tuple[str, ...]) -> DataFrame:
    """(outcome, reason): rows measured against other data don't share a table, then rows measured by other means; an unknown leaves it open."""
    listed = [(k, True) for k in MEASURED_AGAINST] + [(k, False) for k in measuring]
    keys = one.sparkSession.createDataFrame(listed, "ingredient string, data boolean")
    rows = F.broadcast(keys).join(compared(one, two), "ingredient", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    has = lambda state, data=None: F.max(((F.col("state") == state) & (F.lit(True) if data is None else F.col("data") == data)).cast("int")) == 1
    why = F.when(has("differs", True), "other data").when(has("differs", False), "other means").when(has("unknown"), "not on record").otherwise("same data, same means")
    return rows.agg(why.alias("reason")).select(F.when(F.col("reason").startswith("other"), "not_comparable").when(F.col("reason") == "not on record", UNKNOWN).otherwise("comparable").alias("outcome"), "reason")


def assembled(rows: DataFrame) -> DataFrame:
    """Rows of a bridge (row, sample, ground_truth, query_subset, …) with whether each may share the table of the first (by `row`)."""
    first = rows.orderBy("row").limit(1).select(*(F.col(c).alias(f"__{c}") for c in MEASURED_AGAINST))
    both = rows.join(F.broadcast(first))
    differs = F.lit(False)
    unknown = F.lit(False)
    for c in MEASURED_AGAINST:
        differs = differs | F.coalesce(F.col(c) != F.col(f"__{c}"), F.lit(False))
        unknown = unknown | F.col(c).isNull() | F.col(f"__{c}").isNull()
    verdict = F.when(differs, "not_comparable").when(unknown, UNKNOWN).otherwise("comparable")
    return both.withColumn("outcome", verdict).drop(*(f"__{c}" for c in MEASURED_AGAINST))


#: What may be compared across embedding models, what belongs to one model, and what can't be measured.
ACROSS_MODELS = ("boundary_crispness", "intrinsic_dimensionality", "ambiguous_query_rate", "skew_top10_share", "drift", "routing_ceiling", "storage_amplification", "copies_p50", "copies_p95", "copies_p99", "copies_histogram")
OF_ONE_MODEL = ("recall_at_1", "recall_at_10", "recall_at_100", "index_loss", "inv_ratio_at_10", "ceiling_at_10")
NOT_MEASURABLE = ("answer_quality", "relevance", "which_model_is_better")


def registers(measures: DataFrame) -> DataFrame:
    """(…, measure) to register and outcome: only measures of the first register may be compared across models; an unclassified one is refused."""
    m = F.col("measure")
    register = F.when(m.isin(*ACROSS_MODELS), "comparable").when(m.isin(*OF_ONE_MODEL), "per_model").when(m.isin(*NOT_MEASURABLE), "not_measurable")
    return measures.withColumn("register", F.coalesce(register, F.lit("unclassified"))).withColumn("outcome", F.when(F.col("register") == "comparable", "compared").otherwise("refused"))


def truncation_confound(rates: DataFrame, above: float = 0.05) -> DataFrame:
    """(model, fraction) to whether a model cut more texts than the best by over `above`; with fewer than two rates it can't be checked."""
    of = rates.agg(F.min("fraction").alias("lowest"), F.count("fraction").alias("known"))
    out = F.when((F.col("known") < 2) | F.col("fraction").isNull(), UNKNOWN).when(F.col("fraction") - F.col("lowest") > above, "confounded").otherwise("clear")
    return rates.join(F.broadcast(of)).select("model", "fraction", (F.col("fraction") - F.col("lowest")).alias("above_lowest"), out.alias("outcome"))


def by_dimension(models: DataFrame) -> DataFrame:
    """(model, dimension) to bytes of a vector and its size beside the smallest: what is due to the dimension alone."""
    least = models.agg(F.min("dimension").alias("least"))
    return models.join(F.broadcast(least)).select("model", "dimension", (F.col("dimension") * 4).alias("bytes"), (F.col("dimension") / F.col("least")).alias("times"))


def latest(history: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last line for each key wins."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at))
    return history.withColumn("__i", F.row_number().over(order)).where("__i = 1").drop("__i")


def calibrated(rows: DataFrame) -> DataFrame:
    """(…, measured, published, tolerance) to verified, contradicted or couldnt_check, each by its own tolerance."""
    gone = F.col("measured").isNull() | F.col("published").isNull() | F.col("tolerance").isNull()
    return rows.withColumn("outcome", F.when(gone, UNKNOWN).when(F.abs(F.col("measured") - F.col("published")) <= F.col("tolerance"), "verified").otherwise("contradicted"))


def downgraded(rows: DataFrame, unpinned: bool) -> DataFrame:
    """Outside the pinned environment nothing is verified; what is contradicted stays so."""
    return rows.withColumn("outcome", F.when(F.lit(unpinned) & (F.col("outcome") == "verified"), UNKNOWN).otherwise(F.col("outcome")))


def digest_rows(listed: DataFrame, there: DataFrame) -> DataFrame:
    """Listed files (name, sha256) against those there: verified, contradicted, or couldn't be checked where one is absent; others are unlisted."""
    both = listed.withColumnRenamed("sha256", "x").join(there.withColumnRenamed("sha256", "y"), "name", "full")
    return both.select("name", F.when(F.col("x").isNull(), "unlisted").when(F.col("y").isNull(), UNKNOWN).when(F.col("x") == F.col("y"), "verified").otherwise("contradicted").alias("outcome"))


def history_lines(lines: DataFrame) -> DataFrame:
    """Calibration lines (at, check, dataset, engine, engine_version, config, measured, reference, tolerance, scope) with deviation and outcome, which are
    derived, never taken over. A line without a tolerance reaches no verdict; a missing scope is blocking."""
    deviation = F.bround(F.col("measured") - F.col("reference"), 9)
    out = F.when(deviation.isNull() | F.col("tolerance").isNull(), UNKNOWN).when(F.abs(deviation) <= F.col("tolerance"), "verified").otherwise("contradicted")
    return lines.withColumn("deviation", deviation).withColumn("outcome", out).withColumn("scope", F.coalesce("scope", F.lit("blocking")))


def history_state(lines: DataFrame) -> DataFrame:
    """The last line of each check, dataset, engine and configuration."""
    return latest(history_lines(lines), ["check", "dataset", "engine", "config"], "at")


def engine_calibration(lines: DataFrame) -> DataFrame:
    """The last blocking line of each engine; advisory lines never speak for one."""
    return latest(history_lines(lines).where("scope = 'blocking'"), ["engine"], "at")


def calibration_curve(measured: DataFrame, published: DataFrame, tolerance: float) -> DataFrame:
    """(ef, recall) against (ef, recall) published: offsets and their residuals from the mean offset; unpublished points can't be checked, and are never interpolated."""
    both = measured.withColumnRenamed("recall", "measured").join(published.withColumnRenamed("recall", "published"), "ef", "left").withColumn("offset", F.col("measured") - F.col("published"))
    mean = both.agg(F.avg("offset").alias("mean"))
    off = F.col("offset") - F.col("mean")
    return both.join(F.broadcast(mean)).select("ef", "measured", "published", F.round("offset", 9).alias("offset"), F.round(off, 9).alias("residual"), F.when(off.isNull(), UNKNOWN).when(F.abs(F.col("offset")) <= tolerance, "verified").otherwise("contradicted").alias("outcome"))


def predictions(rows: DataFrame) -> DataFrame:
    """(…, before, after, direction, threshold, tolerance): a change of the said direction held, didn't, or is too near the threshold to tell.

    Directions rises and falls are changes; at_or_below and at_or_above are bounds of a side effect on `after` alone.
    """
    d = F.col("direction")
    change = F.bround(F.when(d == "falls", F.col("before") - F.col("after")).when(d == "rises", F.col("after") - F.col("before")), 6)
    bound = d.isin("at_or_below", "at_or_above")
    off = F.bround(F.when(bound, F.col("after")).otherwise(change) - F.col("threshold"), 6)
    right = F.when(d == "at_or_below", off < 0).otherwise(off > 0)
    return rows.withColumn("change", change).withColumn("outcome", F.when(off.isNull() | (F.abs(off) < F.col("tolerance")), UNKNOWN).when(right, "held").otherwise("did_not_hold"))


def judged_prediction(rows: DataFrame, cited: str | None, digest: str, run_seed: int, seed: int) -> DataFrame:
    """One outcome for a whole prediction: a run that cites none or another, or has another seed, can't judge it; then any row that did not hold, any that couldn't be checked."""
    wrong = F.lit("no prediction is cited" if not cited else "another prediction is cited" if cited != digest else "another seed" if run_seed != seed else None).cast("string")
    some = lambda o: F.coalesce(F.max((F.col("outcome") == o).cast("int")), F.lit(0)) == 1
    whole = F.when(some("did_not_hold"), "did_not_hold").when(some(UNKNOWN), UNKNOWN).otherwise("held")
    return predictions(rows).agg(whole.alias("o")).select(F.when(wrong.isNotNull(), UNKNOWN).otherwise(F.col("o")).alias("outcome"), wrong.alias("reason"))


def card_order(rows: DataFrame) -> DataFrame:
    """Judged rows (at, kind, outcome) with their place on a card: broken budgets (side effects), broken predictions, predictions, budgets; stable by `at`."""
    broken, budget = F.col("outcome") == "did_not_hold", F.col("kind") == "side_effect"
    rank = F.when(broken & budget, 0).when(broken, 1).when(~budget, 2).otherwise(3)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(rank, "at")))


def missing_fields(cards: DataFrame, required: DataFrame, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Cards as (card, path, value) against required paths: all that are missing, at once; a path among `nullable` must be there but may be null."""
    wanted = cards.select("card").distinct().join(F.broadcast(required.select("path")))
    there = cards.where(F.col("value").isNotNull() | F.col("path").isin(*nullable)).select("card", "path").distinct()
    gone = wanted.join(there, ["card", "path"], "left_anti")
    return gone.groupBy("card").agg(F.array_join(F.sort_array(F.collect_set("path")), ",").alias("missing"))


def card_refusals(cards: DataFrame) -> DataFrame:
    """Cards (card, run, published, withheld, prediction_digest, cited, comparability) to every reason that bars them: no denominator,
    a prediction the run doesn't cite, runs that can't be compared."""
    denominator = F.when(~F.coalesce("withheld", F.lit(False)) & (F.col("run").isNull() | F.col("published").isNull()), "denominator")
    digest = F.when(F.col("prediction_digest").isNull() | (F.col("prediction_digest") == ""), "prediction.digest").when(~F.coalesce("cited", F.lit(False)), "prediction.cited_by_run")
    verdict = F.when(~F.coalesce("comparability", F.lit("")).isin("comparable", UNKNOWN), "comparability")
    reasons = F.filter(F.array(denominator, digest, verdict), lambda r: r.isNotNull())
    return cards.select("card", F.array_join(reasons, ",").alias("reasons"), F.when(F.size(reasons) > 0, "refused").otherwise("publishable").alias("outcome"))


def run_list(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Runs with the number of verdicts of each outcome; a run without a report has none, which isn't zero."""
    count = lambda o: F.sum((F.col("outcome") == o).cast("long")).alias(o)
    return runs.join(verdicts.groupBy("run").agg(*map(count, (MEETS, FAILS, UNKNOWN))), "run", "left").withColumn("reported", F.col(MEETS).isNotNull())


def claim_problems(claims: DataFrame, cites: DataFrame, rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(claim, member, problem) of every claim that its rows don't bear out.

    `claims`: (claim, quantifier, scope, holds_for, constraint, asserts, rule); `cites`: (claim, member, value, outcome); `rows`: (member, constraint, value,
    outcome). A member that holds lies in the scope, each member of the scope is cited, a universal claim holds for all and an existential one for some, what
    is cited is what the row says, and the members that hold are those whose outcomes say so: by `any` of them, by `all`, or by `no_fails`.
    """
    scope = claims.select("claim", F.explode("scope").alias("member"))
    holds = claims.select("claim", F.explode("holds_for").alias("member"))
    said = lambda df, problem: df.select("claim", "member", F.lit(problem).alias("problem"))
    found = [said(holds.join(scope, ["claim", "member"], "left_anti"), "holds outside its scope"), said(scope.join(cites, ["claim", "member"], "left_anti"), "isn't cited")]
    universal = claims.where("quantifier = 'universal'").select("claim")
    found.append(said(scope.join(universal, "claim", "left_semi").join(holds, ["claim", "member"], "left_anti"), "a universal claim doesn't hold here"))
    nobody = claims.where("quantifier = 'existential'").join(holds, "claim", "left_anti")
    found.append(said(nobody.withColumn("member", F.lit(None).cast("string")), "an existential claim holds for nobody"))
    both = cites.join(claims.select("claim", "constraint"), "claim").join(rows.select("member", "constraint", F.col("value").alias("v"), F.col("outcome").alias("o")), ["member", "constraint"])
    found.append(said(both.where(F.abs(F.col("value") - F.col("v")) > tolerance), "cites another value than the row has"))
    found.append(said(both.where(F.col("outcome") != F.col("o")), "cites another outcome than the row has"))
    facts = scope.join(claims.select("claim", "constraint", "asserts", "rule").where("asserts is not null").withColumnRenamed("constraint", "of"), "claim")
    facts = facts.join(rows.where("outcome is not null"), "member").where(F.col("of").isNull() | (F.col("of") == F.col("constraint")))
    like = (F.col("outcome") == F.col("asserts")).cast("int")
    ruled = facts.groupBy("claim", "member").agg(F.first("rule").alias("rule"), F.max(like).alias("some"), F.min(like).alias("every"), F.max((F.col("outcome") == FAILS).cast("int")).alias("fails"))
    ruled = ruled.withColumn("so", F.when(F.col("rule") == "all", F.col("every") == 1).when(F.col("rule") == "no_fails", (F.col("fails") == 0) & (F.col("some") == 1)).otherwise(F.col("some") == 1))
    marked = ruled.join(holds.withColumn("held", F.lit(True)), ["claim", "member"], "left")
    found.append(said(marked.where(F.coalesce("held", F.lit(False)) != F.col("so")), "the rows say otherwise"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def derived_problems(cites: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(claim, op, left, right, value): differences and ratios that don't come out as stated, or can't be recomputed."""
    again = F.when(F.col("op") == "difference", F.col("left") - F.col("right")).when(F.col("op") == "ratio", F.try_divide(F.col("left"), F.col("right")))
    return cites.withColumn("again", again).where(F.col("again").isNull() | F.col("value").isNull() | (F.abs(F.col("value") - F.col("again")) > tolerance)).select("claim", "op", "value", "again")


def replayed(one: DataFrame, two: DataFrame, exempt: tuple[str, ...]) -> DataFrame:
    """Long tables (path, value): paths that differ or are on one side only, but for those named exempt."""
    both = one.withColumnRenamed("value", "x").join(two.withColumnRenamed("value", "y"), "path", "full")
    return both.where(~F.col("x").eqNullSafe(F.col("y")) & ~F.col("path").isin(*exempt)).select("path", "x", "y")


def plan(grid: dict[str, dict[str, list]], most: int | None = None, include: list[tuple[str, dict]] = ()) -> tuple[list[tuple[str, dict]], list[tuple[str, dict, str]]]:
    """Configurations of every family: those of `include` first, then its grid, each once, at most an even share of `most`; what is left out comes back with its reason."""
    from itertools import product

    share, kept, dropped = max(1, most // max(1, len(grid))) if most else None, [], []
    for family in grid:
        keys = sorted(grid[family])
        every = [dict(c) for f, c in include if f == family] + [dict(zip(keys, values, strict=True)) for values in product(*(grid[family][k] for k in keys))]
        once = list({tuple(sorted(c.items())): c for c in every}.values())  # the first place of each
        kept += [(family, c) for c in once[:share]]
        dropped += [(family, c, f"budget: {most} over {len(grid)} families gives {share}; this was at {i} of {len(once)}") for i, c in enumerate(once, 1) if share and i > share]
    return kept, dropped


#: Legal steps of a job. A refusal can come before the work begins.
STEPS = {("queued", "running"), ("queued", "refused"), ("queued", "cancelled"), ("running", "done"), ("running", "failed"), ("running", "refused"), ("running", "cancelled")}


def illegal_steps(log: DataFrame) -> DataFrame:
    """(job, at, state): steps that no rule allows, and first states other than queued."""
    before = F.lag("state").over(Window.partitionBy("job").orderBy("at"))
    legal = log.sparkSession.createDataFrame([(None, "queued"), *sorted(STEPS)], "b string, s string")
    marked = log.withColumn("before", before)
    return marked.join(F.broadcast(legal), F.col("before").eqNullSafe(F.col("b")) & (F.col("state") == F.col("s")), "left_anti").select("job", "at", "before", "state")
