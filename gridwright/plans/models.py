"""Queries on clusters and searches over the pool. Where SQL can't express a model, tests hold it against brute force."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators import cluster, inference, pairs, search
from gridwright.sources.pool import candidate_pool, pool_sql

WIDTH = 64


def standardised(spark: SparkSession, sf: str) -> DataFrame:
    """The first three scaled figures of each candidate."""
    out = cluster.standardise(candidate_pool(spark, sf), "features", WIDTH)
    return out.select("row_id", *[F.round(F.col("scaled")[k], 6).alias(f"f{k}") for k in range(3)])


def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Size of each label and mean distance to its centre."""
    df = candidate_pool(spark, sf)
    centres = cluster.centroids(df, "label", "features", WIDTH)
    rows = df.join(F.broadcast(centres), "label")  # one row a label
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(F.sqrt(cluster.square_distance("features", "centre"))), 6).alias("mean_distance"))


def cluster_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Inertia, Calinski-Harabasz and Davies-Bouldin of the labels."""
    return cluster.validity(candidate_pool(spark, sf), "label", "features", WIDTH).select("clusters", *[F.round(c, 4).alias(c) for c in ("inertia", "calinski_harabasz", "davies_bouldin")])


def cluster_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """Mean silhouette of each label."""
    return cluster.silhouette(candidate_pool(spark, sf), "label", "features", WIDTH).select("label", "n", F.round("silhouette", 6).alias("silhouette"))


def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the scaled features on two principal components, against the labels."""
    df = cluster.standardise(candidate_pool(spark, sf), "features", WIDTH)
    got, _ = cluster.kmeans(cluster.components(df, "scaled", 2), "row_id", "emb", 8, seed=42)
    return got.select("row_id", "cluster", F.round(F.col("emb")[0], 6).alias("x"), F.round(F.col("emb")[1], 6).alias("y"))


def rand_index(spark: SparkSession, sf: str) -> DataFrame:
    """How far two labellings agree: the label and the decade."""
    df = candidate_pool(spark, sf).withColumn("decade", F.floor(F.col("year") / 10))
    return inference.adjusted_rand(df, "label", "decade").select(F.round("ari", 6).alias("ari"))


def neighbor_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest candidates of each by features."""
    met = pairs.feature_pairs(candidate_pool(spark, sf), "row_id", ["features"]).withColumn("d", F.round("features", 9))
    both = met.select("i", "j", "d").union(met.select("j", "i", "d"))
    return inference.neighbour_ranks(both, "i", "j", "d").where("rank <= 3").select("i", "j", "rank")


def embedding_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Trustworthiness and continuity of the first eight features as an embedding."""
    df = candidate_pool(spark, sf).withColumn("small", F.slice("features", 1, 8))
    met = pairs.feature_pairs(df, "row_id", ["features", "small"]).select("i", "j", F.round("features", 9).alias("high"), F.round("small", 9).alias("low"))
    both = met.union(met.select("j", "i", "high", "low"))
    ranked = inference.neighbour_ranks(both, "i", "j", "high").withColumnRenamed("rank", "rank_high")
    ranked = inference.neighbour_ranks(ranked, "i", "j", "low").withColumnRenamed("rank", "rank_low")
    out = cluster.trustworthiness(ranked, 5, df.count())
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def weight_designs(spark: SparkSession, sf: str) -> DataFrame:
    """Designs of 64 weights: discrepancy before, and sums of weights after, they are scaled to sum 1."""
    designs = {"sobol": search.sobol(64, 3), "latin_hypercube": search.latin_hypercube(64, 3, 42)}
    rows = [(name, len(x), round(search.centred_discrepancy(x), 9), round(float(search.simplex(np.where(x.sum(1, keepdims=True) > 0, x, 1.0)).sum()), 6)) for name, x in designs.items()]
    return spark.createDataFrame(rows, "design string, points int, discrepancy double, weight_sum double")


def weight_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All weights on a grid of tenths."""
    return spark.createDataFrame(search.weight_grid(), "alpha double, beta double, gamma double")


def sensitivity_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Weights around the default ones."""
    return spark.createDataFrame(search.sensitivity_grid((0.4, 0.3, 0.3), 0.2), "alpha double, beta double, gamma double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (standardised, cluster_stats, cluster_validity, cluster_silhouette, kmeans_clusters, rand_index, neighbor_ranks, embedding_quality, weight_designs, weight_grid, sensitivity_grid)
    return {f.__name__: f for f in named}


_P = f"p AS MATERIALIZED (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM ({pool_sql()}))"
_LONG = f"{_P}, l AS MATERIALIZED (SELECT row_id, label, unnest(e) AS v, generate_subscripts(e, 1) AS k FROM p)"
_CENTRES = "c AS MATERIALIZED (SELECT label, list(m ORDER BY k) AS centre FROM (SELECT label, k, avg(v) AS m FROM l GROUP BY ALL) GROUP BY label)"


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    grid = "SELECT round(i * 0.1, 3) AS alpha, round(j * 0.1, 3) AS beta, round(1 - i * 0.1 - j * 0.1, 3) AS gamma FROM range(1, 10) a(i), range(1, 10) b(j) WHERE round(1 - i * 0.1 - j * 0.1, 3) > 0.01"
    grid = grid.replace("0.1,", "0.1::DOUBLE,").replace("0.1 -", "0.1::DOUBLE -")
    choose = "sum(n * (n - 1) / 2.0)"
    w = "CASE WHEN w = {k} THEN {v} * (1 + ch) ELSE {v} END"
    a, b, g = (w.format(k=k, v=v) for k, v in enumerate((0.4, 0.3, 0.3)))
    return {
        "standardised": f"WITH {_LONG}, s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS d FROM l WHERE k <= 3 GROUP BY k) SELECT row_id, " + ", ".join(f"round(max(CASE WHEN k = {k + 1} THEN (v - m) / CASE WHEN d > 0 THEN d ELSE 1 END END), 6) AS f{k}" for k in range(3)) + " FROM l JOIN s USING (k) GROUP BY row_id",
        "cluster_stats": f"WITH {_LONG}, {_CENTRES} SELECT label, count(*) AS size, round(avg(list_distance(e, centre)), 6) AS mean_distance FROM p JOIN c USING (label) GROUP BY label",
        "cluster_validity": f"""WITH {_LONG}, {_CENTRES}, r AS (SELECT label, count(*) AS n, avg(list_distance(e, centre)) AS s, sum(pow(list_distance(e, centre), 2)) AS w FROM p JOIN c USING (label) GROUP BY 1),
            whole AS (SELECT list(m ORDER BY k) AS mean FROM (SELECT k, avg(v) AS m FROM l GROUP BY k)), f AS (SELECT * FROM r JOIN c USING (label), whole),
            t AS (SELECT count(*) AS k, sum(w) AS w, sum(n * pow(list_distance(centre, mean), 2)) AS b, sum(n) AS n FROM f), d AS (SELECT avg(m) AS db FROM (SELECT x.label, max((x.s + y.s) / list_distance(x.centre, y.centre)) AS m FROM f x JOIN f y ON x.label <> y.label GROUP BY 1))
            SELECT k AS clusters, round(w, 4) AS inertia, round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz, round(db, 4) AS davies_bouldin FROM t, d""",
        "cluster_silhouette": f"""WITH {_P}, d AS (SELECT x.row_id, x.label, y.label AS other, sum(pow(list_distance(x.e, y.e), 2)) AS s, count(*) AS n FROM p x JOIN p y ON x.row_id <> y.row_id GROUP BY ALL),
            o AS (SELECT row_id, label, max(s / n) FILTER (WHERE other = label) AS a, min(s / n) FILTER (WHERE other <> label) AS b FROM d GROUP BY ALL) SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM o GROUP BY label""",
        "rand_index": f"""WITH {_P}, x AS (SELECT label, year // 10 AS d, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT {choose} AS c, sum(n) AS t FROM x), a AS (SELECT {choose} AS c FROM (SELECT sum(n) AS n FROM x GROUP BY label)), b AS (SELECT {choose} AS c FROM (SELECT sum(n) AS n FROM x GROUP BY d))
            SELECT round((s.c - a.c * b.c / (t * (t - 1) / 2.0)) / ((a.c + b.c) / 2.0 - a.c * b.c / (t * (t - 1) / 2.0)), 6) AS ari FROM s, a, b""",
        "neighbor_ranks": f"WITH {_P} SELECT i, j, rank FROM (SELECT x.row_id AS i, y.row_id AS j, CAST(row_number() OVER (PARTITION BY x.row_id ORDER BY round(list_distance(x.e, y.e), 9), y.row_id) AS INTEGER) AS rank FROM p x JOIN p y ON x.row_id <> y.row_id) WHERE rank <= 3",
        "embedding_quality": f"""WITH {_P}, r AS (SELECT row_number() OVER (PARTITION BY x.row_id ORDER BY round(list_distance(x.e, y.e), 9), y.row_id) AS h, row_number() OVER (PARTITION BY x.row_id ORDER BY round(list_distance(x.e[1:8], y.e[1:8]), 9), y.row_id) AS w FROM p x JOIN p y ON x.row_id <> y.row_id),
            n AS (SELECT count(*) AS n FROM p), q AS (SELECT 1 - 2.0 / (n * 5 * (2 * n - 16)) * sum(CASE WHEN w <= 5 AND h > 5 THEN h - 5 ELSE 0 END) AS t, 1 - 2.0 / (n * 5 * (2 * n - 16)) * sum(CASE WHEN h <= 5 AND w > 5 THEN w - 5 ELSE 0 END) AS c FROM r, n GROUP BY n)
            SELECT round(t, 6) AS trustworthiness, round(c, 6) AS continuity, round((t + c) / 2, 6) AS mean_value FROM q""",
        "weight_grid": grid,
        "sensitivity_grid": f"""SELECT 0.4::DOUBLE AS alpha, 0.3::DOUBLE AS beta, 0.3::DOUBLE AS gamma UNION ALL SELECT round(a / (a + b + g), 9), round(b / (a + b + g), 9), round(g / (a + b + g), 9)
            FROM (SELECT ({a})::DOUBLE AS a, ({b})::DOUBLE AS b, ({g})::DOUBLE AS g FROM (SELECT unnest([0, 1, 2]) AS w), (SELECT unnest([-0.2::DOUBLE, -0.1, 0.1, 0.2]) AS ch))""",
    }
