"""Queries on spatial splits of the pool: links, components, assignment, calibration, audit, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import keys
from gridwright.operators import pairs, splits
from gridwright.session import table
from gridwright.sources.pool import candidate_pool, pool_sql

HALF, LEAST_KM, EDGES, WIDTH_KM = 1500.0, 8.0, [1880, 1900, 1920, 1946], 25.0


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return candidate_pool(spark, sf, HALF)


def leakage_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose rectangles are less than the distance apart."""
    return splits.boxes_within(_pool(spark, sf), "row_id", LEAST_KM).select("a", "b", F.round("edge_km", 6).alias("edge_km"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    """The component of each candidate."""
    return splits.spatial_components(_pool(spark, sf), "row_id", LEAST_KM)


def component_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Size, most common period and region of each component."""
    pool = _pool(spark, sf)
    return splits.component_facts(pool, "row_id", splits.spatial_components(pool, "row_id", LEAST_KM), EDGES)


def split_assign(spark: SparkSession, sf: str) -> DataFrame:
    """The part of each component."""
    return splits.assign_components(component_facts(spark, sf))


def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Components and candidates of each part, with a digest of its ids as JSON."""
    pool = _pool(spark, sf)
    found = splits.spatial_components(pool, "row_id", LEAST_KM)
    parts = splits.assign_components(splits.component_facts(pool, "row_id", found, EDGES)).select("component", "split")
    return found.join(parts, "component").groupBy("split").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("component").alias("component_count"), F.sha2(F.to_json(F.array_sort(F.collect_list("row_id"))), 256).alias("ids_sha256"))


def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of a split by label, which isn't made by distance."""
    split = F.when(F.col("label") < 6, "train").when(F.col("label") < 8, "val").otherwise("test")
    out = splits.leakage_audit(_pool(spark, sf).withColumn("split", split), "row_id", "split", LEAST_KM)
    return out.select("pair_type", "violations", F.round("min_edge_km", 6).alias("min_edge_km"))


def split_is_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of the split by components: none."""
    pool = _pool(spark, sf)
    found = splits.spatial_components(pool, "row_id", LEAST_KM)
    parts = splits.assign_components(splits.component_facts(pool, "row_id", found, EDGES)).select("component", "split")
    rows = pool.join(found, "row_id").join(parts, "component")
    return splits.leakage_audit(rows, "row_id", "split", LEAST_KM).agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pool_pairs(_pool(spark, sf)).select("edge_km", (1 - F.col("cosine")).alias("similarity"))


def leakage_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of pairs by distance."""
    out = splits.binned_similarity(_similar(spark, sf), "edge_km", "similarity", WIDTH_KM)
    return out.select("bin_start_km", "bin_end_km", "n_pairs", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("std_similarity", 6).alias("std_similarity"))


def leakage_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The distance from which similarity is as low as far away."""
    raw = _similar(spark, sf)
    out = splits.calibrate(splits.binned_similarity(raw, "edge_km", "similarity", WIDTH_KM), raw, "edge_km", "similarity")
    return out.select(F.round("d_leak_km", 6).alias("d_leak_km"), "calibrated")


def group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds of patches that keep sheets whole."""
    rows = table(spark, sf, "selected_patches").where("qc_status = 'qc_passed'").select(keys.tile_key(F.col("tile_shortname")).alias("sheet"))
    return splits.grouped_folds(rows, "sheet", 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (leakage_edges, components, component_facts, split_assign, split_manifest, leakage_audit, split_is_clean, leakage_bins, leakage_calibration, group_kfold)
    return {f.__name__: f for f in named}


_POOL = f"pool AS MATERIALIZED ({pool_sql(HALF)})"
_GAP = "sqrt(pow(greatest(a.minx - b.maxx, b.minx - a.maxx, 0), 2) + pow(greatest(a.miny - b.maxy, b.miny - a.maxy, 0), 2)) / 1000"
_EDGES = f"edges AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, {_GAP} AS edge_km FROM pool a JOIN pool b ON a.row_id < b.row_id WHERE {_GAP} < {LEAST_KM})"
_COMPONENTS = """links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT row_id AS x, row_id AS y FROM pool UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a),
comp AS (SELECT x AS row_id, min(y) AS component FROM reach GROUP BY x)"""
_PAIRS = f"raw AS MATERIALIZED (SELECT {_GAP} AS edge_km, 1 - least(greatest(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 1) AS similarity FROM pool a JOIN pool b ON a.row_id < b.row_id)"
_BINS = f"bins AS (SELECT floor(edge_km / {WIDTH_KM}) * {WIDTH_KM} AS bin_start_km, count(*) AS n_pairs, avg(similarity) AS mean_similarity, stddev_pop(similarity) AS std_similarity FROM raw GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    period = " ".join(f"WHEN year >= {a} AND year < {b} THEN '{a}-{b}'" for a, b in zip(EDGES, EDGES[1:]))
    return {
        "leakage_edges": f"WITH {_POOL}, {_EDGES} SELECT a, b, round(edge_km, 6) AS edge_km FROM edges",
        "components": f"WITH RECURSIVE {_POOL}, {_EDGES}, {_COMPONENTS} SELECT row_id, component FROM comp",
        "component_facts": f"""WITH RECURSIVE {_POOL}, {_EDGES}, {_COMPONENTS}, mid AS (SELECT quantile_cont(center_x, 0.5) AS mx, quantile_cont(center_y, 0.5) AS my FROM pool),
            r AS (SELECT component, CASE {period} ELSE 'nan' END AS p, concat(CASE WHEN center_y >= my THEN 'N' ELSE 'S' END, CASE WHEN center_x >= mx THEN 'E' ELSE 'W' END) AS q FROM pool JOIN comp USING (row_id), mid),
            ps AS (SELECT component, p, count(*) AS n FROM r GROUP BY ALL), qs AS (SELECT component, q, count(*) AS n FROM r GROUP BY ALL)
            SELECT component, (SELECT count(*) FROM r WHERE r.component = c.component) AS size, (SELECT p FROM ps WHERE ps.component = c.component ORDER BY n DESC, p LIMIT 1) AS year_mode,
            (SELECT q FROM qs WHERE qs.component = c.component ORDER BY n DESC, q LIMIT 1) AS region_mode FROM (SELECT DISTINCT component FROM comp) c""",
        "leakage_audit": f"""WITH {_POOL}, {_EDGES}, s AS (SELECT row_id, CASE WHEN label < 6 THEN 'train' WHEN label < 8 THEN 'val' ELSE 'test' END AS split FROM pool)
            SELECT concat(least(x.split, y.split), '-', greatest(x.split, y.split)) AS pair_type, count(*) AS violations, round(min(edge_km), 6) AS min_edge_km FROM edges JOIN s x ON x.row_id = a JOIN s y ON y.row_id = b WHERE x.split <> y.split GROUP BY 1""",
        "leakage_bins": f"WITH {_POOL}, {_PAIRS}, {_BINS} SELECT bin_start_km, bin_start_km + {WIDTH_KM} AS bin_end_km, n_pairs, round(mean_similarity, 6) AS mean_similarity, round(std_similarity, 6) AS std_similarity FROM bins",
        "leakage_calibration": f"""WITH {_POOL}, {_PAIRS}, {_BINS}, q AS (SELECT quantile_cont(edge_km, 0.75) AS far, quantile_cont(edge_km, 0.25) AS near FROM raw), l AS (SELECT avg(similarity) AS level FROM raw, q WHERE edge_km >= far),
            w AS (SELECT bin_start_km, max(mean_similarity) OVER v AS m, min(n_pairs) OVER v AS c, count(*) OVER v AS k FROM bins WINDOW v AS (ORDER BY bin_start_km ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
            f AS (SELECT min(bin_start_km) AS d FROM w, l WHERE m <= level + 0.01 AND c >= 5 AND k >= 2) SELECT round(coalesce(d, near), 6) AS d_leak_km, d IS NOT NULL AS calibrated FROM f, q""",
    }
