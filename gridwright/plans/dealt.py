"""Queries of the general operators on nearby points and on units."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.geo import haversine_sql, is_position
from gridwright.operators.nearby import nearest_of_sets, points_in_regions, points_within
from gridwright.operators.units import factors_of, measurement_units, tile_units
from gridwright.session import table

RADIUS_KM = 0.5
#: The regions of p2_regions: an octagon in each square of this many degrees over the area of the sheets.
REGION_STEP, REGION_WEST, REGION_SOUTH, REGION_COLUMNS, REGION_ROWS = 2.0, 4.0, 46.0, 11, 6


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of sheets whose centres are at most half a kilometre apart."""
    pairs = points_within(table(spark, sf, "new_all_tiles"), "tile_id", "lon", "lat", RADIUS_KM)
    return pairs.select(F.col("id_a").alias("tile_a"), F.col("id_b").alias("tile_b"))


def p2_run_min(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest distance of two selected sheets of each run, beside the recorded one."""
    runs = table(spark, sf, "min_distance_runs").select("run_key", "spatial_min_km", "selected_tile_ids").dropDuplicates(["run_key"])
    tiles = table(spark, sf, "new_all_tiles").where(is_position(F.col("lon"), F.col("lat"))).select("tile_id", "lon", "lat")
    chosen = runs.select("run_key", F.explode(F.array_distinct("selected_tile_ids")).alias("tile_id")).join(tiles, "tile_id")
    sets = chosen.groupBy("run_key").agg(F.collect_list("lon").alias("lons"), F.collect_list("lat").alias("lats"))
    near = nearest_of_sets(sets, "lons", "lats", "km").select("run_key", "km")
    recorded = F.when(~F.isnan("spatial_min_km"), F.col("spatial_min_km"))
    return runs.join(near, "run_key", "left").select("run_key", F.round("km", 6).alias("min_km"), recorded.alias("recorded_km"))


def p2_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The octagonal region that holds each sheet's centre."""
    places = spark.range(REGION_COLUMNS * REGION_ROWS)
    column, row = F.col("id") % REGION_COLUMNS, F.floor(F.col("id") / REGION_COLUMNS)
    cut = 0.25  # of a square's side, at each corner
    corners = [(cut, 0.0), (1 - cut, 0.0), (1.0, cut), (1.0, 1 - cut), (1 - cut, 1.0), (cut, 1.0), (0.0, 1 - cut), (0.0, cut)]
    ring = F.array(*[F.struct(((column + x) * REGION_STEP + REGION_WEST).alias("x"), ((row + y) * REGION_STEP + REGION_SOUTH).alias("y")) for x, y in corners])
    regions = places.select(F.col("id").alias("region_id"), ring.alias("ring"))
    tiles = table(spark, sf, "new_all_tiles").where(is_position(F.col("lon"), F.col("lat")))
    return points_in_regions(tiles, "tile_id", "lon", "lat", regions, "region_id", "ring", REGION_STEP).select(F.col("id").alias("tile_id"), F.col("region").alias("region_id"))


def p7_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value present with its unit and in base units."""
    factors = factors_of(table(spark, sf, "unit_factors"))
    tiles = tile_units(table(spark, sf, "real_tiles_metadata"), factors).withColumn("record_kind", F.lit("tile"))
    rows = measurement_units(table(spark, sf, "width_measurements"), factors).withColumn("record_kind", F.lit("measurement"))
    return tiles.unionByName(rows).select("record_kind", "record_id", "field_name", "raw", "unit_code", "base_value", "unique")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are really in another unit than metres or pixels."""
    return p7_values(spark, sf).where(~F.col("unit_code").isin("m", "px")).select("record_kind", "record_id", "field_name", "unit_code").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (p2_found, p2_run_min, p2_regions, p7_found, p7_values)}


_PLACED = "(SELECT tile_id, lon, lat FROM new_all_tiles WHERE NOT isnan(lon) AND NOT isnan(lat) AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0))"
_APART = haversine_sql("a.lon", "a.lat", "b.lon", "b.lat")


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name, without grids or cells."""
    return {
        "p2_found": f"""SELECT a.tile_id AS tile_a, b.tile_id AS tile_b FROM {_PLACED} a JOIN {_PLACED} b ON a.tile_id < b.tile_id
            AND b.lat BETWEEN a.lat - {math.degrees(RADIUS_KM / 6371.0) * 1.001} AND a.lat + {math.degrees(RADIUS_KM / 6371.0) * 1.001} WHERE {_APART} <= {RADIUS_KM}""",
        "p2_run_min": f"""WITH runs AS (SELECT DISTINCT ON (run_key) run_key, spatial_min_km, selected_tile_ids FROM min_distance_runs),
            s AS (SELECT DISTINCT run_key, unnest(selected_tile_ids) AS tile_id FROM runs), p AS (SELECT run_key, tile_id, lon, lat FROM s JOIN {_PLACED} USING (tile_id)),
            m AS (SELECT a.run_key, min({_APART}) AS km FROM p a JOIN p b ON a.run_key = b.run_key AND a.tile_id < b.tile_id GROUP BY 1)
            SELECT run_key, round(km, 6) AS min_km, CASE WHEN NOT isnan(spatial_min_km) THEN spatial_min_km END AS recorded_km FROM runs LEFT JOIN m USING (run_key)""",
        "p2_regions": f"""WITH p AS (SELECT tile_id, (lon - {REGION_WEST}) / {REGION_STEP} AS u, (lat - {REGION_SOUTH}) / {REGION_STEP} AS v FROM {_PLACED}),
            q AS (SELECT tile_id, floor(u) AS i, floor(v) AS j, u - floor(u) AS x, v - floor(v) AS y FROM p)
            SELECT tile_id, CAST(j * {REGION_COLUMNS} + i AS BIGINT) AS region_id FROM q WHERE i BETWEEN 0 AND {REGION_COLUMNS - 1} AND j BETWEEN 0 AND {REGION_ROWS - 1}
            AND x + y >= 0.25 AND (1 - x) + y > 0.25 AND x + (1 - y) >= 0.25 AND (1 - x) + (1 - y) > 0.25""",
    }
