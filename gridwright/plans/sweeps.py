"""Queries on sweeps: scored selections, early stops, fronts, grids, feasibility, choices among candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators import inference, objective, search, selection
from gridwright.plans.selection import rounded_scores, scores_sql
from gridwright.plans.trials import _RUNS, _runs
from gridwright.session import table
from gridwright.sources.pool import candidate_pool, pool_sql

#: Size that each label's members are held against, and trials without a better score after which a sweep ends.
TARGET, PATIENCE = 50, 3
DISTANCES = (20.0, 28.5, 40.0)
#: Share of the asked size from which a run counts as feasible.
FEASIBLE = 0.9


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """The pool's labels as selections: each scored over all its members."""
    pool = candidate_pool(spark, sf)
    chosen = pool.where("label is not null").select(F.col("label").alias("config_id"), "row_id")
    return objective.scored_selections(chosen, pool, chosen.select("config_id").distinct().withColumn("k", F.lit(TARGET)))


def objective_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and normalised objective of the members of each label; too small ones are penalised."""
    return rounded_scores(_scored(spark, sf))


def sweep_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Where a sweep over the labels in their order would end for want of a better score."""
    scores = objective_scores(spark, sf).select("config_id", "objective_score")
    return objective.patience(scores, "config_id", "objective_score", 0.0, PATIENCE).select("config_id", "objective_score", F.col("stale").cast("long").alias("stale"), "stopped")


def lexicographic_best(spark: SparkSession, sf: str) -> DataFrame:
    """The label that leads by clusters covered, then spread of years, then mean distance; ties go to the lowest."""
    return _scored(spark, sf).select("config_id", "clusters_covered", F.round("temporal_std", 6).alias("temporal_std"), F.round("spatial_mean_km", 6).alias("spatial_mean_km")).orderBy(F.desc("clusters_covered"), F.desc("temporal_std"), F.desc("spatial_mean_km"), "config_id").limit(1)


def explore_front(spark: SparkSession, sf: str) -> DataFrame:
    """The scored labels that none beats in spread of years, mean distance and few war years at once."""
    rows = objective_scores(spark, sf).select("config_id", "temporal_std", "spatial_mean_km", "wwi_percent")
    return selection.pareto_front(rows, "config_id", ["temporal_std", "spatial_mean_km"], ["wwi_percent"])


def fine_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The settings of the fine sweep: its weights at each distance, and how many recorded runs of that distance there are."""
    weights = spark.createDataFrame(search.fine_grid(), "alpha double, beta double, gamma double")
    distances = spark.createDataFrame([(d,) for d in DISTANCES], "distance double")
    runs = _runs(spark, sf).groupBy("distance").agg(F.count(F.lit(1)).alias("runs"))
    # a few dozen settings
    return weights.crossJoin(distances).join(runs, "distance", "left").select("alpha", "beta", "gamma", "distance", F.coalesce("runs", F.lit(0)).alias("runs"))


def ablation_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The scenarios that switch parts off, each scored on the means of the recorded runs' figures."""
    means = _runs(spark, sf).agg(F.avg("temporal_std").alias("t"), F.avg("spatial_mean_km").alias("s"), F.avg("wwi_percent").alias("w"))
    rows = [(name, *w) for name, w in search.ablation_scenarios().items()]
    scenarios = spark.createDataFrame(rows, "scenario string, alpha double, beta double, gamma double")
    score = F.col("alpha") * F.col("w") + F.col("beta") * F.col("s") + F.col("gamma") * F.col("t")
    return scenarios.crossJoin(F.broadcast(means)).select("scenario", F.round("alpha", 9).alias("alpha"), F.round("beta", 9).alias("beta"), F.round("gamma", 9).alias("gamma"), F.round(score, 6).alias("weighted"))  # one row


def feasible_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that reached nine tenths of the size they were asked for."""
    return _runs(spark, sf).where(F.col("n_selected") >= FEASIBLE * F.col("n_requested")).select("run_key", "distance", "n_requested", "n_selected")


def feasibility_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of each distance, how many of them fell short, and the median size."""
    short = F.count_if(F.col("n_selected") < FEASIBLE * F.col("n_requested"))
    return _runs(spark, sf).groupBy("distance").agg(F.count(F.lit(1)).alias("total_runs"), short.alias("infeasible_count"), F.round(short / F.count(F.lit(1)) * 100, 6).alias("infeasible_pct"), F.floor(F.expr("percentile(n_selected, 0.5)")).alias("median_n_selected"))


def swap_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap, swaps and Jaccard index of the selections of each two runs of one distance and size."""
    runs = _runs(spark, sf).select("run_key", "distance", "n_requested", F.array_distinct("selected_tile_ids").alias("ids"))
    a, b = runs.alias("a"), runs.alias("b")
    met = a.join(b, (F.col("a.distance") == F.col("b.distance")) & (F.col("a.n_requested") == F.col("b.n_requested")) & (F.col("a.run_key") < F.col("b.run_key")))
    same = F.size(F.array_intersect("a.ids", "b.ids"))
    return met.select(F.col("a.run_key").alias("run_a"), F.col("b.run_key").alias("run_b"), same.alias("overlap_count"), (F.greatest(F.size("a.ids"), F.size("b.ids")) - same).alias("swap_count"), F.round(objective.jaccard(F.col("a.ids"), F.col("b.ids")), 6).alias("jaccard"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    one = runs.groupBy("distance", "n_requested").agg(F.count(F.lit(1)).alias("replicates"), *[f(c).alias(f"{c}_{n}") for c in ("temporal_std", "wwi_percent", "n_selected") for n, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))))])
    swaps = swap_counts(spark, sf).join(runs.select(F.col("run_key").alias("run_a"), "distance", "n_requested"), "run_a").groupBy("distance", "n_requested").agg(F.avg("jaccard").alias("jaccard_mean"))
    return one.join(swaps, ["distance", "n_requested"], "left").na.fill(1.0, ["jaccard_mean"])


def candidate_summary(spark: SparkSession, sf: str) -> DataFrame:
    """For each candidate, a distance and size: replicates, means and deviations of their figures, mean overlap."""
    out = _candidates(spark, sf)
    return out.select("distance", "n_requested", "replicates", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


def bootstrap_best(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate with the steadiest selection, then most war years, then the smallest distance and size."""
    out = _candidates(spark, sf).select("distance", "n_requested", F.round("jaccard_mean", 6).alias("jaccard_mean"), F.round("wwi_percent_mean", 6).alias("wwi_mean"))
    return out.orderBy(F.desc("jaccard_mean"), F.desc("wwi_mean"), "distance", "n_requested").limit(1)


def best_production_run(spark: SparkSession, sf: str) -> DataFrame:
    """The best run of those that met the hard cut, or of all if none did."""
    runs = _runs(spark, sf).where("temporal_std is not null")
    order = F.struct("temporal_std", (-F.col("run_key")).alias("i"))
    out = runs.agg(F.max_by("run_key", F.when(F.col("hardcut_target_met"), order)).alias("good"), F.max_by("run_key", order).alias("any_run"))
    return out.select(F.coalesce("good", "any_run").alias("run_key"), F.col("good").isNotNull().alias("production"))


def benchmark_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The type of events with the least mean value, then the least mean hour: the rule that picks a sampling method by
    discrepancy and then by time."""
    rows = table(spark, sf, "events").where("value is not null").groupBy("event_type").agg(F.avg("value").alias("m"), F.avg(F.hour("ts")).alias("t"))
    return rows.select("event_type", F.round("m", 6).alias("mean_discrepancy"), F.round("t", 6).alias("mean_time")).orderBy("mean_discrepancy", "mean_time", "event_type").limit(1)


def scenario_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Each figure of the runs of each distance: count, mean, deviation, median, least and greatest."""
    long = _runs(spark, sf).unpivot(["distance"], ["temporal_std", "spatial_mean_km", "wwi_percent"], "endpoint", "v").where("v is not null")
    out = long.groupBy("distance", "endpoint").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.expr("percentile(v, 0.5)").alias("median"), F.min("v").alias("least"), F.max("v").alias("most"))
    return out.select("distance", "endpoint", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "least", "most")])


def endpoint_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Paired differences of two distances, and whether the runs are independent enough to be tested at all: a distance whose
    runs all gave one selection only replays it."""
    runs = _runs(spark, sf)
    long = runs.unpivot(["distance", "seed", "n_requested"], ["temporal_std", "spatial_mean_km"], "endpoint", "v").where("v is not null")
    long = long.withColumn("pair", F.concat_ws("-", "seed", "n_requested")).withColumn("scenario", F.col("distance").cast("string"))
    out = inference.delta_summary(inference.paired_deltas(long, "pair", "scenario", "v", "10.0", "45.0", "endpoint"), "endpoint")
    ids = F.array_join(F.array_sort(F.array_distinct("selected_tile_ids")).cast("array<string>"), "|")
    different = runs.where("distance in (10.0, 45.0)").agg(F.when(F.count_distinct(ids) > 1, "independent").otherwise("replay").alias("inference_status"))
    return out.crossJoin(F.broadcast(different)).select("endpoint", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_delta", "median_delta", "std_delta", "standardised")], "direction", "inference_status")  # one row


def augmented_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features with the year in a fortieth as many further places, scaled by a weight and the features' deviation; shown by their
    number, sum and last value."""
    pool = selection.with_years(candidate_pool(spark, sf), "features", "year", 0.3)
    return pool.select("row_id", F.size("features").alias("size"), F.round(F.aggregate("features", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(F.element_at("features", -1), 6).alias("last"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (objective_scores, sweep_early_stop, lexicographic_best, explore_front, fine_sweep, ablation_weights, feasible_runs, feasibility_summary, swap_counts, candidate_summary, bootstrap_best, best_production_run, benchmark_choice, scenario_endpoints, endpoint_deltas, augmented_features)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    chosen = f"SELECT label AS config_id, row_id, {TARGET} AS k FROM pool WHERE label IS NOT NULL"
    scores = f"WITH pool AS MATERIALIZED ({pool_sql()}), {scores_sql(chosen)}"
    ids = "list_sort(list_distinct(selected_tile_ids))"
    swaps = f"""r AS (SELECT run_key, distance, n_requested, temporal_std, wwi_percent, n_selected, {ids} AS ids FROM {_RUNS}),
      w AS (SELECT a.distance, a.n_requested, a.run_key AS run_a, b.run_key AS run_b, len(list_intersect(a.ids, b.ids)) AS o, greatest(len(a.ids), len(b.ids)) AS m, len(list_distinct(list_concat(a.ids, b.ids))) AS u FROM r a JOIN r b ON a.distance = b.distance AND a.n_requested = b.n_requested AND a.run_key < b.run_key),
      j AS (SELECT *, round(CASE WHEN u = 0 THEN 1.0 ELSE o / u END, 6) AS jaccard FROM w)"""
    one = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_std" for c in ("temporal_std", "wwi_percent", "n_selected"))
    cand = f"WITH {swaps}, c AS (SELECT distance, n_requested, count(*) AS replicates, {one} FROM r GROUP BY 1, 2), m AS (SELECT distance, n_requested, avg(jaccard) AS jm FROM j GROUP BY 1, 2), s AS (SELECT c.*, round(coalesce(jm, 1.0), 6) AS jaccard_mean FROM c LEFT JOIN m USING (distance, n_requested))"
    long = " UNION ALL ".join(f"SELECT distance, seed, n_requested, '{m}' AS endpoint, {m} AS v FROM {_RUNS} WHERE {m} IS NOT NULL" for m in ("temporal_std", "spatial_mean_km", "wwi_percent"))
    grid = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {g!r}::DOUBLE)" for a, b, g in search.fine_grid())
    abl = ", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {g!r}::DOUBLE)" for n, (a, b, g) in search.ablation_scenarios().items())
    return {
        "objective_scores": scores,
        "sweep_early_stop": f"""WITH s AS (SELECT config_id, objective_score FROM ({scores})), m AS (SELECT *, max(objective_score) OVER (ORDER BY config_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
            i AS (SELECT *, sum(CASE WHEN b IS NULL OR objective_score > b THEN 1 ELSE 0 END) OVER (ORDER BY config_id) AS island FROM m), t AS (SELECT config_id, objective_score, row_number() OVER (PARTITION BY island ORDER BY config_id) - 1 AS stale FROM i)
            SELECT config_id, objective_score, stale, max(CASE WHEN stale >= {PATIENCE} THEN 1 ELSE 0 END) OVER (ORDER BY config_id) = 1 AS stopped FROM t""",
        "lexicographic_best": f"SELECT config_id, clusters_covered, temporal_std, spatial_mean_km FROM ({scores}) ORDER BY clusters_covered DESC, temporal_std DESC, spatial_mean_km DESC, config_id LIMIT 1",
        "explore_front": f"WITH s AS MATERIALIZED (SELECT config_id, temporal_std, spatial_mean_km, wwi_percent FROM ({scores})) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.temporal_std >= a.temporal_std AND b.spatial_mean_km >= a.spatial_mean_km AND b.wwi_percent <= a.wwi_percent AND (b.temporal_std > a.temporal_std OR b.spatial_mean_km > a.spatial_mean_km OR b.wwi_percent < a.wwi_percent))",
        "fine_sweep": f"WITH w(alpha, beta, gamma) AS (VALUES {grid}), d(distance) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in DISTANCES)}), r AS (SELECT distance, count(*) AS runs FROM {_RUNS} GROUP BY 1) SELECT alpha, beta, gamma, distance, coalesce(runs, 0) AS runs FROM w CROSS JOIN d LEFT JOIN r USING (distance)",
        "ablation_weights": f"WITH a(scenario, alpha, beta, gamma) AS (VALUES {abl}), m AS (SELECT avg(temporal_std) AS t, avg(spatial_mean_km) AS s, avg(wwi_percent) AS w FROM {_RUNS}) SELECT scenario, round(alpha, 9) AS alpha, round(beta, 9) AS beta, round(gamma, 9) AS gamma, round(alpha * w + beta * s + gamma * t, 6) AS weighted FROM a, m",
        "feasible_runs": f"SELECT run_key, distance, n_requested, n_selected FROM {_RUNS} WHERE n_selected >= 0.9::DOUBLE * n_requested",
        "feasibility_summary": f"SELECT distance, count(*) AS total_runs, count(*) FILTER (WHERE n_selected < 0.9::DOUBLE * n_requested) AS infeasible_count, round(count(*) FILTER (WHERE n_selected < 0.9::DOUBLE * n_requested) / count(*) * 100, 6) AS infeasible_pct, CAST(floor(quantile_cont(n_selected, 0.5)) AS BIGINT) AS median_n_selected FROM {_RUNS} GROUP BY distance",
        "swap_counts": f"WITH {swaps} SELECT run_a, run_b, CAST(o AS INTEGER) AS overlap_count, CAST(m - o AS INTEGER) AS swap_count, jaccard FROM j",
        "candidate_summary": f"{cand} SELECT * FROM s",
        "bootstrap_best": f"{cand} SELECT distance, n_requested, jaccard_mean, wwi_percent_mean AS wwi_mean FROM s ORDER BY jaccard_mean DESC, wwi_mean DESC, distance, n_requested LIMIT 1",
        "best_production_run": f"SELECT coalesce(g, a) AS run_key, g IS NOT NULL AS production FROM (SELECT first(run_key ORDER BY temporal_std DESC, run_key) FILTER (WHERE hardcut_target_met) AS g, first(run_key ORDER BY temporal_std DESC, run_key) AS a FROM {_RUNS} WHERE temporal_std IS NOT NULL)",
        "benchmark_choice": "SELECT event_type, round(avg(CAST(value AS DOUBLE)), 6) AS mean_discrepancy, round(avg(hour(ts)), 6) AS mean_time FROM events WHERE value IS NOT NULL GROUP BY 1 ORDER BY mean_discrepancy, mean_time, event_type LIMIT 1",
        "scenario_endpoints": f"SELECT distance, endpoint, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(min(v), 6) AS least, round(max(v), 6) AS most FROM ({long}) GROUP BY 1, 2",
        "endpoint_deltas": f"""WITH l AS (SELECT * FROM ({long}) WHERE endpoint <> 'wwi_percent'), p AS (SELECT endpoint, seed, n_requested, avg(v) FILTER (WHERE distance = 10) AS a, avg(v) FILTER (WHERE distance = 45) AS b FROM l GROUP BY 1, 2, 3),
            d AS (SELECT endpoint, b - a AS delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL), s AS (SELECT endpoint, count(*) AS pairs, avg(delta) AS m, quantile_cont(delta, 0.5) AS md, coalesce(stddev_samp(delta), 0) AS sd FROM d GROUP BY 1),
            i AS (SELECT CASE WHEN count(DISTINCT array_to_string({ids}, '|')) > 1 THEN 'independent' ELSE 'replay' END AS inference_status FROM {_RUNS} WHERE distance IN (10, 45))
            SELECT endpoint, pairs, round(m, 6) AS mean_delta, round(md, 6) AS median_delta, round(sd, 6) AS std_delta, round(CASE WHEN pairs < 2 THEN 'nan'::DOUBLE WHEN sd > 1e-12 THEN m / sd WHEN m > 1e-12 THEN 'inf'::DOUBLE WHEN m < -1e-12 THEN '-inf'::DOUBLE ELSE 0 END, 6) AS standardised,
              CASE WHEN m > 0 THEN 'second' WHEN m < 0 THEN 'first' ELSE 'no_change' END AS direction, inference_status FROM s, i""",
        "augmented_features": f"""WITH pool AS MATERIALIZED ({pool_sql()}), v AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x FROM pool), g AS (SELECT stddev_pop(x) AS sd FROM v), y AS (SELECT quantile_cont(year, 0.5) AS med, any_value(len(embedding)) AS d FROM pool),
            z AS (SELECT row_id, embedding, coalesce(year, med) AS year, greatest(1, CAST(round_even(d * 0.025, 0) AS INT)) AS t FROM pool, y), r AS (SELECT min(year) AS lo, max(year) AS hi FROM z), a AS (SELECT row_id, embedding, t, CASE WHEN hi > lo THEN (year - lo) / (hi - lo) ELSE 0 END * 0.3 * sd AS e FROM z, r, g)
            SELECT row_id, CAST(len(embedding) + t AS INTEGER) AS size, round(list_sum(CAST(embedding AS DOUBLE[])) + t * e, 6) AS total, round(e, 6) AS last FROM a""",
    }
