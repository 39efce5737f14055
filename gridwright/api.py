"""The engine's surface: DataFrame in, DataFrame out. And functions for SQL."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from gridwright.functions.geo import EARTH_KM
from gridwright.operators import inference, objective, pairs, policy, selection, splits


def select_diverse(pool: DataFrame, k: int, least_km: float = 0.0, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), mode: str = "unified", seeds: Sequence[int] = (), metric: str = "edge") -> DataFrame:
    """A varied subset; see :func:`gridwright.operators.selection.select`. ``k`` must be given; more than there are gives all."""
    if k is None or k <= 0:
        raise ValueError("k must be positive")
    settings = pool.sparkSession.createDataFrame([(0, *map(float, weights), int(k), float(least_km))], selection.SETTINGS)
    return selection.select(pool, settings, mode, seeds, metric).drop("config_id")


def sweep(pool: DataFrame, settings: list[tuple[float, float, float, int, float]]) -> DataFrame:
    """Choices, metrics and objective of many settings ``(alpha, beta, gamma, k, least_km)``, worked on in parallel."""
    table = pool.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(settings)], selection.SETTINGS)
    chosen = selection.select(pool, table).join(pool, "row_id")
    scored = objective.selection_metrics(chosen, "config_id").join(table.select("config_id", "alpha", "beta", "gamma", "k", "least_km"), "config_id")
    return objective.normalised_objective(scored, pool)


def metrics(selected: DataFrame, run: str) -> DataFrame:
    return objective.selection_metrics(selected, run)


def pareto_front(df: DataFrame, key: str, largest: list[str], smallest: list[str] = ()) -> DataFrame:
    return selection.pareto_front(df, key, largest, list(smallest))


def bootstrap(rows: DataFrame, by: str, value: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Interval of the mean of each group."""
    return inference.summary(inference.bootstrap(rows, by, value, replicates, seed), [by], "value")


def spatial_splits(pool: DataFrame, least_km: float, edges: list[int], shares: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """``row_id, component, split``: components of the distance graph dealt to parts; clean by construction."""
    found = splits.spatial_components(pool, "row_id", least_km)
    parts = splits.assign_components(splits.component_facts(pool, "row_id", found, edges), shares)
    return found.join(parts.select("component", "split"), "component")


def leakage_safe_splits(pool: DataFrame, least_km: float | None, edges: list[int]) -> DataFrame:
    """:func:`spatial_splits`, audited: an error if any two parts are nearer than the distance. Without a distance it is the
    one from which on candidates are no more alike than far ones, from all pairs of the pool."""
    if least_km is None:
        raw = pairs.pool_pairs(pool).select(F.col("edge_km").alias("km"), (1 - F.col("cosine")).alias("similarity"))
        least_km = calibrate_leakage(raw, "km", "similarity", CALIBRATION_KM).first()["d_leak_km"]
    out = spatial_splits(pool, least_km, edges)
    if not splits.leakage_audit(pool.join(out, "row_id"), "row_id", "split", least_km).isEmpty():
        raise RuntimeError("the parts are nearer to each other than the distance")
    return out


#: Width of the bins of distance in which similarities are averaged.
CALIBRATION_KM = 5.0


def calibrate_leakage(pairs: DataFrame, km: str, similarity: str, width_km: float) -> DataFrame:
    return splits.calibrate(splits.binned_similarity(pairs, km, similarity, width_km), pairs, km, similarity)


def apply_policy(df: DataFrame, rules: dict[str, Any], key: str) -> tuple[DataFrame, DataFrame]:
    return policy.apply_policy(df, rules, key)


@udtf(returnType="i bigint, j bigint")
class UnorderedPairs:
    """Each pair of an array of ids once: ``SELECT * FROM unordered_pairs(array(3, 1, 2))``."""

    def eval(self, ids: list[int] | Row | None):
        known = sorted({i for i in ids or [] if i is not None})
        for k, i in enumerate(known):
            for j in known[k + 1 :]:
                yield i, j


def register_functions(spark: SparkSession) -> None:
    """``haversine_km``, ``edge_distance_km`` and ``unordered_pairs`` for SQL; the first two are expressions, not Python."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE
        RETURN 2 * {EARTH_KM}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION edge_distance_km(minx1 DOUBLE, maxx1 DOUBLE, miny1 DOUBLE, maxy1 DOUBLE, minx2 DOUBLE, maxx2 DOUBLE, miny2 DOUBLE, maxy2 DOUBLE) RETURNS DOUBLE
        RETURN hypot(greatest(minx1 - maxx2, minx2 - maxx1, 0D), greatest(miny1 - maxy2, miny2 - maxy1, 0D)) / 1000""")
    spark.udtf.register("unordered_pairs", UnorderedPairs)
