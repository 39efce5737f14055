"""Queries on trials, runs and statistics of them. The events are taken as trials: a value each, in the order of their ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions.geo import haversine_km, haversine_sql, is_position
from gridwright.operators import inference, objective
from gridwright.session import table

TOLERANCES = {"hardcut_rate": 0.05, "clusters_mean": 0.5, "temporal_std_mean": 1.0, "spatial_mean_km": 20.0}


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id"), "event_type", F.col("value").cast("double").alias("value"), "ts")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, the last delivery of each; NaN as null."""
    df = table(spark, sf, "min_distance_runs")
    last = df.groupBy("run_key").agg(F.max_by(F.struct(*[c for c in df.columns if c != "run_key"]), F.struct("ingested_at", "recorded_at")).alias("r")).select("run_key", "r.*")
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return last.select("run_key", "distance", "seed", "n_requested", "n_selected", "shortfall", "hardcut_target_met", "clusters_covered", clean("temporal_std"), clean("temporal_range"), clean("spatial_mean_km"), clean("spatial_min_km"), clean("wwi_percent"), "selected_tile_ids")


def convergence(spark: SparkSession, sf: str) -> DataFrame:
    """For each type of event: trials, best value, and the first trial within one per cent of it."""
    out = objective.first_within(_trials(spark, sf).where("value is not null"), "event_type", "event_id", "value")
    return out.select("event_type", "trials", F.round("best", 6).alias("best"), "reached")


def running_best(spark: SparkSession, sf: str) -> DataFrame:
    """Trials that raised the best value of their user so far."""
    curve = objective.running_best(_trials(spark, sf).where("value is not null"), "user_id", "event_id", "value")
    before = F.lag("best").over(Window.partitionBy("user_id").orderBy("event_id"))
    return curve.withColumn("_before", before).where("_before is null or best > _before").select("user_id", "event_id", F.round("best", 6).alias("best"))


def median_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The median over users of the running best at each position, up to the longest run."""
    rows = _trials(spark, sf).where("value is not null").withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    curve = objective.running_best(rows, "user_id", "event_id", "value")
    return curve.groupBy("position").agg(F.count(F.lit(1)).alias("users"), F.round(F.expr("percentile(best, 0.5)"), 6).alias("median_best"))


def patience_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Where a run over daily bests would stop after three days without gain."""
    days = _trials(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("best"))
    return objective.patience(days, "day", "best", 0.0, 3).select("day", F.round("best", 6).alias("best"), F.col("stale").cast("long").alias("stale"), "stopped")


def trial_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Count, best and its first trial, mean, deviation and median by type."""
    return _trials(spark, sf).groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.max("value"), 6).alias("best"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_trial"), F.round(F.avg("value"), 6).alias("mean_value"),
                                                        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std_value"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("median_value"))


def best_type(spark: SparkSession, sf: str) -> DataFrame:
    """The type that leads by mean, and the mean of means."""
    means = _trials(spark, sf).groupBy("event_type").agg(F.avg("value").alias("m"))
    return means.agg(F.max_by("event_type", F.struct("m", "event_type")).alias("best_type"), F.round(F.max("m"), 6).alias("best_mean"), F.round(F.avg("m"), 6).alias("mean_of_means"))


def plateau_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest selection whose score is within three per cent of the best feasible one."""
    trials = _runs(spark, sf).select(F.col("run_key").alias("number"), F.col("n_requested").alias("n"), F.col("temporal_std").alias("value"), F.col("hardcut_target_met").alias("feasible")).where("value is not null")
    return objective.plateau(trials).select("number", "n", F.round("value", 6).alias("value"))


def policy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of the runs of each distance: rates, means and deviations (of the population)."""
    return _runs(spark, sf).groupBy("distance").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("hardcut_target_met").cast("double")), 6).alias("hardcut_rate"), F.round(F.avg("shortfall"), 6).alias("shortfall_mean"), F.round(F.avg("clusters_covered"), 6).alias("clusters_mean"),
        F.round(F.avg("temporal_std"), 6).alias("temporal_std_mean"), F.round(F.stddev_pop("temporal_std"), 6).alias("temporal_std_std"), F.round(F.avg("spatial_mean_km"), 6).alias("spatial_mean_km"), F.round(F.avg("wwi_percent"), 6).alias("wwi_mean"),
    )


def recommend_distance(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest distance nearly as good as the best."""
    return objective.recommend_distance(policy_summary(spark, sf), TOLERANCES)


def long_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Each metric of each distance: count, mean, deviation, median and quantiles."""
    metrics = ["temporal_std", "temporal_range", "spatial_mean_km", "wwi_percent"]
    long = _runs(spark, sf).unpivot(["distance"], metrics, "metric", "v").where("v is not null")
    out = inference.summary(long, ["distance", "metric"], "v")
    return out.select("distance", "metric", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "q025", "q975")])


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and least overlap of the selections of each distance and size, over pairs of runs."""
    runs = _runs(spark, sf).select("run_key", "distance", "n_requested", F.array_sort(F.array_distinct("selected_tile_ids")).alias("ids"))
    a, b = runs.alias("a"), runs.alias("b")
    met = a.join(b, (F.col("a.distance") == F.col("b.distance")) & (F.col("a.n_requested") == F.col("b.n_requested")) & (F.col("a.run_key") < F.col("b.run_key")))
    value = objective.jaccard(F.col("a.ids"), F.col("b.ids"))
    return met.groupBy("a.distance", "a.n_requested").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(value), 6).alias("jaccard_mean"), F.round(F.min(value), 6).alias("jaccard_min"))


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """How many different selections the runs of a distance and size gave."""
    runs = _runs(spark, sf).withColumn("signature", F.sha2(F.array_join(F.array_sort(F.array_distinct("selected_tile_ids")).cast("array<string>"), "|"), 256))
    return runs.groupBy("distance", "n_requested").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("signature").alias("different"), F.when(F.count_distinct("signature") == 1, "replay").otherwise("independent").alias("status"))


def selection_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded selections' figures, worked out again from the tiles."""
    chosen = _runs(spark, sf).select("run_key", F.explode(F.array_distinct("selected_tile_ids")).alias("tile_id"))
    tiles = table(spark, sf, "new_all_tiles").select("tile_id", "year", F.when(is_position(F.col("lon"), F.col("lat")), F.col("lon")).alias("lon"), F.when(is_position(F.col("lon"), F.col("lat")), F.col("lat")).alias("lat"))
    rows = chosen.join(tiles, "tile_id")
    one = rows.groupBy("run_key").agg(F.count(F.lit(1)).alias("n_selected"), F.round(F.coalesce(F.stddev_samp("year"), F.lit(0.0)), 6).alias("temporal_std"), F.coalesce(F.max("year") - F.min("year"), F.lit(0)).alias("temporal_range"), F.round(objective.war_share(F.col("year")), 6).alias("wwi_percent"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.run_key") == F.col("b.run_key")) & (F.col("a.tile_id") < F.col("b.tile_id")))
    km = haversine_km(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    apart = met.groupBy(F.col("a.run_key").alias("run_key")).agg(F.round(F.avg(km), 6).alias("spatial_mean_km"), F.round(F.min(km), 6).alias("spatial_min_km"))
    return one.join(apart, "run_key", "left")


def pivot_paired(spark: SparkSession, sf: str) -> DataFrame:
    """The mean value of each user's events of two types, side by side."""
    rows = _trials(spark, sf)
    return rows.groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.round(F.avg("value"), 6))


def endpoint_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Paired differences of runs of two distances with equal seed and size."""
    runs = _runs(spark, sf)
    long = runs.unpivot(["distance", "seed", "n_requested"], ["temporal_std", "spatial_mean_km"], "endpoint", "v").where("v is not null")
    out = inference.paired_endpoints(long.withColumn("pair", F.concat_ws("-", "seed", "n_requested")).withColumn("scenario", F.col("distance").cast("string")), "pair", "scenario", "v", "10.0", "45.0", "endpoint")
    return out.select("endpoint", "pairs", F.round("mean_delta", 6).alias("mean_delta"), F.round("std_delta", 6).alias("std_delta"), F.round("standardised", 6).alias("standardised"), F.round("p_value", 6).alias("p_value"))


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile intervals of the mean temporal spread by distance, from 500 resamples."""
    reps = inference.bootstrap(_runs(spark, sf), "distance", "temporal_std", 500, seed=42)
    return reps.groupBy("distance").agg(F.count(F.lit(1)).alias("replicates"), F.round(F.expr("percentile(value, 0.025)"), 6).alias("low"), F.round(F.expr("percentile(value, 0.975)"), 6).alias("high"))


def distance_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds around the median of the best runs' distances, kept within 10 and 100, and a grid of three."""
    runs = _runs(spark, sf).where("hardcut_target_met")
    middle = F.expr("percentile(distance, 0.5)")
    top = F.max_by("distance", F.struct("temporal_std", "run_key"))
    return runs.agg(F.greatest(F.lit(10.0), middle - 10).alias("low"), F.least(F.lit(100.0), middle + 10).alias("high"), F.array(top - 5, top, top + 5).alias("grid"))


def common_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all runs name the same manifest, and how many they name."""
    return table(spark, sf, "split_audits").agg(F.count_distinct("split_manifest_sha256").alias("hashes"), (F.count_distinct("split_manifest_sha256") == 1).alias("common"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (convergence, running_best, median_curve, patience_stop, trial_stats, best_type, plateau_choice, policy_summary, recommend_distance, long_summary, jaccard_pairs, signatures, selection_metrics, pivot_paired, endpoint_stats, bootstrap_ci, distance_bounds, common_hash)
    return {f.__name__: f for f in named}


_RUNS = """(SELECT * EXCLUDE (k, temporal_std, temporal_range, spatial_mean_km, spatial_min_km, wwi_percent), CASE WHEN NOT isnan(temporal_std) THEN temporal_std END AS temporal_std, CASE WHEN NOT isnan(temporal_range) THEN temporal_range END AS temporal_range,
  CASE WHEN NOT isnan(spatial_mean_km) THEN spatial_mean_km END AS spatial_mean_km, CASE WHEN NOT isnan(spatial_min_km) THEN spatial_min_km END AS spatial_min_km, CASE WHEN NOT isnan(wwi_percent) THEN wwi_percent END AS wwi_percent
  FROM (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY ingested_at DESC, recorded_at DESC) AS k FROM min_distance_runs) WHERE k = 1)"""
_EV = "(SELECT event_id, user_id, event_type, CAST(value AS DOUBLE) AS value, ts FROM events)"
_SUMMARY = f"""SELECT distance, count(*) AS runs, round(avg(CAST(hardcut_target_met AS INT)), 6) AS hardcut_rate, round(avg(shortfall), 6) AS shortfall_mean, round(avg(clusters_covered), 6) AS clusters_mean, round(avg(temporal_std), 6) AS temporal_std_mean,
  round(stddev_pop(temporal_std), 6) AS temporal_std_std, round(avg(spatial_mean_km), 6) AS spatial_mean_km, round(avg(wwi_percent), 6) AS wwi_mean FROM {_RUNS} GROUP BY distance"""


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    near = " AND ".join(f"s.{c} >= l.{c} - {t}" for c, t in TOLERANCES.items())
    lead = ", ".join(f"{c} DESC" for c in TOLERANCES)
    metric = " UNION ALL ".join(f"SELECT distance, '{m}' AS metric, {m} AS v FROM {_RUNS} WHERE {m} IS NOT NULL" for m in ("temporal_std", "temporal_range", "spatial_mean_km", "wwi_percent"))
    ids = "list_sort(list_distinct(selected_tile_ids))"
    km = haversine_sql("a.lon", "a.lat", "b.lon", "b.lat")
    placed = "NOT isnan(lon) AND NOT isnan(lat) AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0)"
    return {
        "convergence": f"""WITH c AS (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b, max(value) OVER (PARTITION BY event_type) AS top FROM {_EV} WHERE value IS NOT NULL)
            SELECT event_type, count(*) AS trials, round(max(b), 6) AS best, min(event_id) FILTER (WHERE b >= top * 0.99) AS reached FROM c GROUP BY event_type""",
        "running_best": f"""WITH c AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {_EV} WHERE value IS NOT NULL) SELECT user_id, event_id, round(value, 6) AS best FROM c WHERE b IS NULL OR value > b""",
        "median_curve": f"""WITH c AS (SELECT user_id, row_number() OVER w AS position, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best FROM {_EV} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
            SELECT CAST(position AS INTEGER) AS position, count(*) AS users, round(quantile_cont(best, 0.5), 6) AS median_best FROM c GROUP BY position""",
        "patience_stop": f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, max(value) AS best FROM {_EV} GROUP BY 1), m AS (SELECT *, max(best) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d),
            i AS (SELECT *, sum(CASE WHEN b IS NULL OR best > b THEN 1 ELSE 0 END) OVER (ORDER BY day) AS island FROM m), s AS (SELECT day, best, row_number() OVER (PARTITION BY island ORDER BY day) - 1 AS stale FROM i)
            SELECT day, round(best, 6) AS best, stale, max(CASE WHEN stale >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY day) = 1 AS stopped FROM s""",
        "trial_stats": f"SELECT event_type, count(value) AS n, round(max(value), 6) AS best, first(event_id ORDER BY value DESC NULLS LAST, event_id) AS best_trial, round(avg(value), 6) AS mean_value, round(coalesce(stddev_samp(value), 0), 6) AS std_value, round(quantile_cont(value, 0.5), 6) AS median_value FROM {_EV} GROUP BY event_type",
        "best_type": f"WITH m AS (SELECT event_type, avg(value) AS m FROM {_EV} GROUP BY 1) SELECT first(event_type ORDER BY m DESC, event_type DESC) AS best_type, round(max(m), 6) AS best_mean, round(avg(m), 6) AS mean_of_means FROM m",
        "plateau_choice": f"WITH g AS (SELECT run_key AS number, n_requested AS n, temporal_std AS value FROM {_RUNS} WHERE hardcut_target_met AND temporal_std IS NOT NULL) SELECT number, n, round(value, 6) AS value FROM g WHERE value >= (SELECT max(value) FROM g) * 0.97 ORDER BY n, g.value DESC, number LIMIT 1",
        "policy_summary": _SUMMARY,
        "recommend_distance": f"WITH s AS ({_SUMMARY}), l AS (SELECT * FROM s ORDER BY {lead}, distance LIMIT 1) SELECT min(s.distance) AS recommended_distance FROM s, l WHERE {near}",
        "long_summary": f"SELECT distance, metric, count(*) AS count, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.975), 6) AS q975 FROM ({metric}) GROUP BY distance, metric",
        "jaccard_pairs": f"""WITH r AS (SELECT run_key, distance, n_requested, {ids} AS ids FROM {_RUNS}), p AS (SELECT a.distance, a.n_requested, CASE WHEN len(a.ids) + len(b.ids) = 0 THEN 1.0 ELSE len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))) END AS j FROM r a JOIN r b ON a.distance = b.distance AND a.n_requested = b.n_requested AND a.run_key < b.run_key)
            SELECT distance, n_requested, count(*) AS pairs, round(avg(j), 6) AS jaccard_mean, round(min(j), 6) AS jaccard_min FROM p GROUP BY ALL""",
        "signatures": f"SELECT distance, n_requested, count(*) AS runs, count(DISTINCT array_to_string({ids}, '|')) AS different, CASE WHEN count(DISTINCT array_to_string({ids}, '|')) = 1 THEN 'replay' ELSE 'independent' END AS status FROM {_RUNS} GROUP BY distance, n_requested",
        "selection_metrics": f"""WITH c AS (SELECT DISTINCT run_key, unnest(selected_tile_ids) AS tile_id FROM {_RUNS}), t AS (SELECT run_key, tile_id, year, CASE WHEN {placed} THEN lon END AS lon, CASE WHEN {placed} THEN lat END AS lat FROM c JOIN new_all_tiles USING (tile_id)),
            o AS (SELECT run_key, count(*) AS n_selected, round(coalesce(stddev_samp(year), 0), 6) AS temporal_std, coalesce(max(year) - min(year), 0) AS temporal_range, round(coalesce(count(*) FILTER (WHERE year BETWEEN 1914 AND 1918) * 100.0 / nullif(count(year), 0), 0), 6) AS wwi_percent FROM t GROUP BY 1),
            m AS (SELECT a.run_key, round(avg({km}), 6) AS spatial_mean_km, round(min({km}), 6) AS spatial_min_km FROM t a JOIN t b ON a.run_key = b.run_key AND a.tile_id < b.tile_id GROUP BY 1) SELECT * FROM o LEFT JOIN m USING (run_key)""",
        "pivot_paired": f"SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS purchase FROM {_EV} GROUP BY user_id",
        "distance_bounds": f"SELECT greatest(10.0, m - 10) AS low, least(100.0, m + 10) AS high, [t - 5, t, t + 5] AS grid FROM (SELECT quantile_cont(distance, 0.5) AS m, first(distance ORDER BY temporal_std DESC NULLS LAST, run_key DESC) AS t FROM {_RUNS} WHERE hardcut_target_met)",
        "common_hash": "SELECT count(DISTINCT split_manifest_sha256) AS hashes, count(DISTINCT split_manifest_sha256) = 1 AS common FROM split_audits",
    }
