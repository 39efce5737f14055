"""Queries behind reports: resampled selections, comparisons of runs, eligibility, stages, manifests, SQL functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright import api
from gridwright.functions import keys
from gridwright.operators import contract, inference, objective, search, selection, uncertainty
from gridwright.session import table
from gridwright.sources.pool import candidate_pool, pool_sql

REPLICATES, K, LEAST_KM = 200, 24, 28.5


def bootstrap_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Selections from resamples of the pool, mapped back to ids, and their overlap with the selection from the pool itself."""
    pool = candidate_pool(spark, sf)
    settings = spark.createDataFrame([(r, 0.4, 0.3, 0.3, K, LEAST_KM) for r in range(REPLICATES + 1)], selection.SETTINGS)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p, rep = selection.Pool(group), int(group["config_id"].iloc[0])
        # replicate 0 is the pool itself; the others draw positions, and a candidate drawn twice stands twice
        drawn = np.arange(len(p.ids)) if rep == 0 else np.random.default_rng([42, rep]).integers(0, len(p.ids), len(p.ids))
        if len(p.ids) > selection.DENSE:
            chosen, _ = selection.greedy_by_blocks(len(drawn), selection.unified_similarity(p, (0.4, 0.3, 0.3), drawn), K, lambda c: p.edge_km([drawn[c]])[0, drawn], LEAST_KM)
        else:
            d = p.unified(0.4, 0.3, 0.3)[np.ix_(drawn, drawn)]
            chosen, _ = selection.greedy(d.max() - d, K, p.edge_km()[np.ix_(drawn, drawn)], LEAST_KM)
        ids = list(dict.fromkeys(p.ids[drawn[chosen]].tolist()))
        return pd.DataFrame({"replicate": [rep], "ids": [ids], "shortfall": [max(0, K - len(ids))]})

    both = settings.select("config_id").join(pool)
    reps = both.groupBy("config_id").applyInPandas(run, "replicate int, ids array<bigint>, shortfall int")
    whole = reps.where("replicate = 0").select(F.col("ids").alias("_ids"))
    met = reps.where("replicate > 0").crossJoin(F.broadcast(whole))  # one row
    return met.select("replicate", "shortfall", (F.col("shortfall") == 0).alias("target_met"), F.round(objective.jaccard(F.col("ids"), F.col("_ids")), 6).alias("jaccard"))


def ensemble_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    """How far an ensemble disagrees on the year of a candidate, over the pool."""
    pool = candidate_pool(spark, sf)
    out = uncertainty.uncertainty_summary(uncertainty.ensemble(pool, "row_id", "features", "year", members=5))
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


def sampler_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Rank test and effect size between the values of each two types of events."""
    rows = table(spark, sf, "events").where("value is not null").select("event_type", F.col("value").cast("double").alias("value"))
    sets = rows.groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("v"))

    @F.pandas_udf("u double, p_value double, effect double")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*inference.mann_whitney(x, y), inference.cohens_d(x, y)) for x, y in zip(a, b)], columns=["u", "p_value", "effect"])

    x, y = sets.alias("x"), sets.alias("y")
    met = x.join(y, F.col("x.event_type") < F.col("y.event_type"))  # a row for each two types
    out = met.select(F.col("x.event_type").alias("type_a"), F.col("y.event_type").alias("type_b"), compare("x.v", "y.v").alias("c")).select("type_a", "type_b", "c.*")
    # no p-value here: SQL has no error function to hold it against; inference.mann_whitney gives it
    return out.select("type_a", "type_b", F.round("u", 3).alias("u"), F.round("effect", 6).alias("effect"))


def trial_report(spark: SparkSession, sf: str) -> DataFrame:
    """The block of a report on runs: all, complete, best and first best, mean and deviation."""
    runs = table(spark, sf, "min_distance_runs").where(~F.isnan("temporal_std")).dropDuplicates(["run_key"])
    complete = F.col("hardcut_target_met")
    v = F.when(complete, F.col("temporal_std"))
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(complete).alias("complete"), F.round(F.max(v), 6).alias("best"), F.max_by("run_key", F.when(complete, F.struct(F.col("temporal_std"), -F.col("run_key")))).alias("best_run"), F.round(F.avg(v), 6).alias("mean_value"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std_value"))


def two_run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of runs with and without shortfall, side by side."""
    runs = table(spark, sf, "min_distance_runs").dropDuplicates(["run_key"])
    long = runs.withColumn("side", F.when(F.col("shortfall") > 0, "short").otherwise("full")).unpivot(["side"], ["temporal_std", "wwi_percent"], "metric", "v").where(~F.isnan("v"))
    return long.groupBy("metric").pivot("side", ["full", "short"]).agg(F.round(F.avg("v"), 6))


def candidate_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Measured anchors that a patch around them would fit: inside the margins, one for each pixel of a patch."""
    df = table(spark, sf, "width_tasks").where("patch_id is not null")
    half = F.floor(F.col("crop_size_px") / 2)
    inside = (F.col("anchor_x_px") - half >= 0) & (F.col("anchor_y_px") - half >= 0) & (F.col("anchor_x_px") + half <= 1024) & (F.col("anchor_y_px") + half <= 1024)
    return df.where(inside).groupBy("patch_id", "anchor_x_px", "anchor_y_px").agg(F.min("task_key").alias("task_key"))


def autoscale_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Stages for the pool: sizes, trials, bounds of the first weight, and whether the stage takes the whole pool."""
    n = table(spark, sf, "embeddings").count()
    stages = search.corridor_stages(n)
    trials = search.trial_schedule(len(stages))
    low, high = search.narrow(0.4)
    return spark.createDataFrame([(i, k, t, low, high, search.covers_all(k, n)) for i, (k, t) in enumerate(zip(stages, trials))], "stage int, n_samples int, trials int, low double, high double, diagnostic_only boolean")


def subset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The folds of the patches of the first ten ranks, empty folds kept."""
    df = table(spark, sf, "selected_patches").where("selection_rank < 10 and split_fold is not null")
    counts = df.groupBy("split_fold").agg(F.count(F.lit(1)).alias("patches"), F.sha2(F.array_join(F.array_sort(F.collect_list("patch_id")), "|"), 256).alias("ids_sha256"))
    folds = spark.range(1, 6).select(F.col("id").cast("int").alias("split_fold"))
    return folds.join(counts, "split_fold", "left").select("split_fold", F.coalesce("patches", F.lit(0)).alias("patches"), "ids_sha256")


def leakage_safe_split(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each part of an audited split at 8 km."""
    pool = candidate_pool(spark, sf, 1500.0)
    return api.leakage_safe_splits(pool, 8.0, [1880, 1900, 1920, 1946]).groupBy("split").agg(F.count(F.lit(1)).alias("candidates"))


def calibrated_split(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each part of a split at the calibrated distance, audited."""
    pool = candidate_pool(spark, sf, 1500.0)
    return api.leakage_safe_splits(pool, None, [1880, 1900, 1920, 1946]).groupBy("split").agg(F.count(F.lit(1)).alias("candidates"))


def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Distances by the SQL functions, between sheets whose ids follow each other."""
    api.register_functions(spark)
    tiles = table(spark, sf, "new_all_tiles").select("tile_id", "lon", "lat", "ul_x", "ul_y", "lr_x", "lr_y").where("lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)")
    text = """SELECT a.tile_id, round(haversine_km(a.lon, a.lat, b.lon, b.lat), 6) AS km, round(edge_distance_km(a.ul_x, a.lr_x, a.lr_y, a.ul_y, b.ul_x, b.lr_x, b.lr_y, b.ul_y), 6) AS edge_km
        FROM {tiles} a JOIN {tiles} b ON b.tile_id = a.tile_id + 1 WHERE a.ul_x IS NOT NULL AND b.ul_x IS NOT NULL AND a.lr_x IS NOT NULL AND b.lr_x IS NOT NULL"""
    return spark.sql(text, tiles=tiles)


def table_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and order-free digest of the list of sheets."""
    return contract.row_basis_digest(table(spark, sf, "new_all_tiles"), ["tile_id", "shortname", "city", "year"])


def selection_table(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of the sheets selected for patches, with the cities they cover."""
    df = table(spark, sf, "selected_patches").select(keys.tile_key(F.col("tile_shortname")).alias("sheet"), "selection_rank", keys.clean(F.col("tile_city")).alias("city")).where("sheet is not null")
    return df.groupBy("sheet").agg(F.min("selection_rank").alias("selection_rank"), F.min("city").alias("city"), F.count(F.lit(1)).alias("patches"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (bootstrap_selection, ensemble_uncertainty, sampler_comparison, trial_report, two_run_comparison, candidate_eligibility, autoscale_stages, subset_manifest, leakage_safe_split, calibrated_split, sql_functions, table_digest, selection_table)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    runs = "(SELECT DISTINCT ON (run_key) * FROM min_distance_runs WHERE NOT isnan(temporal_std))"
    ok = "hardcut_target_met"
    placed = "NOT isnan(lon) AND NOT isnan(lat) AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0)"
    km = "2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
    side = "SELECT '{m}' AS metric, {m} AS v, CASE WHEN shortfall > 0 THEN 'short' ELSE 'full' END AS side FROM (SELECT DISTINCT ON (run_key) * FROM min_distance_runs) WHERE NOT isnan({m})"
    both = " UNION ALL ".join(side.format(m=m) for m in ("temporal_std", "wwi_percent"))
    return {
        "trial_report": f"SELECT count(*) AS runs, count(*) FILTER (WHERE {ok}) AS complete, round(max(temporal_std) FILTER (WHERE {ok}), 6) AS best, first(run_key ORDER BY temporal_std DESC, run_key) FILTER (WHERE {ok}) AS best_run, round(avg(temporal_std) FILTER (WHERE {ok}), 6) AS mean_value, round(coalesce(stddev_samp(temporal_std) FILTER (WHERE {ok}), 0), 6) AS std_value FROM {runs}",
        "two_run_comparison": f"SELECT metric, round(avg(v) FILTER (WHERE side = 'full'), 6) AS \"full\", round(avg(v) FILTER (WHERE side = 'short'), 6) AS short FROM ({both}) GROUP BY metric",
        "candidate_eligibility": "SELECT patch_id, anchor_x_px, anchor_y_px, min(task_key) AS task_key FROM width_tasks WHERE patch_id IS NOT NULL AND anchor_x_px - crop_size_px // 2 >= 0 AND anchor_y_px - crop_size_px // 2 >= 0 AND anchor_x_px + crop_size_px // 2 <= 1024 AND anchor_y_px + crop_size_px // 2 <= 1024 GROUP BY 1, 2, 3",
        "subset_manifest": "SELECT CAST(f AS INTEGER) AS split_fold, count(patch_id) AS patches, CASE WHEN count(patch_id) > 0 THEN sha256(string_agg(patch_id, '|' ORDER BY patch_id)) END AS ids_sha256 FROM range(1, 6) r(f) LEFT JOIN (SELECT * FROM selected_patches WHERE selection_rank < 10) p ON p.split_fold = f GROUP BY f",
        "sql_functions": f"""WITH t AS (SELECT * FROM new_all_tiles WHERE {placed}) SELECT a.tile_id, round({km}, 6) AS km, round(sqrt(pow(greatest(a.ul_x - b.lr_x, b.ul_x - a.lr_x, 0), 2) + pow(greatest(a.lr_y - b.ul_y, b.lr_y - a.ul_y, 0), 2)) / 1000, 6) AS edge_km
            FROM t a JOIN t b ON b.tile_id = a.tile_id + 1 WHERE a.ul_x IS NOT NULL AND b.ul_x IS NOT NULL AND a.lr_x IS NOT NULL AND b.lr_x IS NOT NULL""",
        "sampler_comparison": """WITH e AS (SELECT event_type, CAST(value AS DOUBLE) AS value FROM events WHERE value IS NOT NULL), t AS (SELECT DISTINCT event_type FROM e), p AS (SELECT a.event_type AS x, b.event_type AS y FROM t a JOIN t b ON a.event_type < b.event_type),
            r AS (SELECT x, y, e.event_type AS g, value, rank() OVER (PARTITION BY x, y ORDER BY value) + (count(*) OVER (PARTITION BY x, y, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY x, y, value) AS same FROM p JOIN e ON e.event_type IN (x, y)),
            s AS (SELECT x, y, count(*) FILTER (WHERE g = x) AS n, count(*) FILTER (WHERE g = y) AS m, sum(r) FILTER (WHERE g = x) AS rs, sum(same * same - 1.0) AS ties, avg(value) FILTER (WHERE g = x) AS ma, avg(value) FILTER (WHERE g = y) AS mb, var_samp(value) FILTER (WHERE g = x) AS va, var_samp(value) FILTER (WHERE g = y) AS vb FROM r GROUP BY x, y)
            SELECT x AS type_a, y AS type_b, round(rs - n * (n + 1) / 2.0, 3) AS u, round((ma - mb) / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2)), 6) AS effect FROM s""",
        "selection_table": f"SELECT {keys.tile_key_sql('tile_shortname')} AS sheet, min(selection_rank) AS selection_rank, min({keys.clean_sql('tile_city')}) AS city, count(*) AS patches FROM selected_patches GROUP BY 1 HAVING sheet IS NOT NULL",
        "autoscale_stages": f"""WITH n AS (SELECT count(*) AS n, least(96, count(*)) AS most FROM ({pool_sql()})), b AS (SELECT n, most, greatest(1, least(most, round_even(n * 0.04, 0))) AS lo, least(most, round_even(n * 0.08, 0)) AS hi FROM n),
            c AS (SELECT n, CAST(least(greatest(lo, least(24, most)), greatest(lo, hi)) AS INT) AS lo, CAST(greatest(lo, hi) AS INT) AS hi FROM b),
            s AS (SELECT DISTINCT n, unnest(list_append(range(lo, hi + 1), CAST(greatest(lo, least(hi, round_even(n * 0.05, 0))) AS BIGINT))) AS k FROM c), m AS (SELECT count(*) AS m FROM s)
            SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS stage, CAST(k AS INTEGER) AS n_samples, CAST(CASE WHEN m <= 4 THEN [30, 40, 60, 80][row_number() OVER (ORDER BY k)] ELSE greatest(8, round_even(320 / m, 0)) END AS INTEGER) AS trials, 0.2::DOUBLE AS low, 0.4::DOUBLE + 0.2::DOUBLE AS high, k >= n AS diagnostic_only FROM s, m""",
    }
