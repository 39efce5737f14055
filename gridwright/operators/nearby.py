"""Points near other points, and points in regions, by grid cells and exact checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.geo import EARTH_KM, haversine_km, is_position
from gridwright.operators.skew import join_hot

#: Points that one task of the join holds of one cell before the cell is split.
CELL_ROWS = 2000


def _band_columns(band: Column, height: float, cell_km: float, radius: float) -> Column:
    """Number of cells around the globe in a band of latitude, each at least ``cell_km`` wide at the band's narrow side."""
    far = F.greatest(F.abs(band * height - 90.0), F.abs((band + 1) * height - 90.0))
    round_km = F.cos(F.radians(F.least(far, F.lit(90.0)))) * (2 * math.pi * radius)
    return F.greatest(F.floor(round_km / cell_km), F.lit(1)).cast("long")


def points_within(points: DataFrame, id_col: str, lon: str, lat: str, radius_km: float, earth_km: float = EARTH_KM, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(id_a, id_b, km)``, id_a < id_b, for each pair of points at most ``radius_km`` apart on a sphere.

    Points are hashed to cells at least the radius high and wide, in bands of latitude, so that cells stay near square up to
    the poles and wrap at 180 degrees. A point is compared with the points of its own cell, of its neighbours in the band
    and of those in the next band; what the cells bring together is checked by great-circle distance. Cells with more than
    ``cell_rows`` points are split by a hash of the id and their visitors copied to each part, so a crowded town spreads
    over many tasks. Points with null, NaN or impossible coordinates or at (0, 0), and null ids, are in no pair. Equal
    positions are pairs; an id given twice counts once a position. Other columns are ignored.
    """
    if not radius_km > 0:
        raise ValueError("the radius must be positive")
    height = math.degrees(radius_km / earth_km) * 1.0000001
    bands = math.floor(180.0 / height)
    pts = points.select(F.col(id_col).alias("id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    pts = pts.where(F.col("id").isNotNull() & is_position(F.col("lon"), F.col("lat")))
    pts = pts.withColumn("band", F.least(F.floor((F.col("lat") + 90.0) / height), F.lit(bands)).cast("long"))

    def place(band: Column, degrees: Column) -> Column:
        return F.floor((degrees + 180.0) / 360.0 * _band_columns(band, height, radius_km, earth_km)).cast("long")

    columns = _band_columns(F.col("band"), height, radius_km, earth_km)
    home = pts.withColumn("cell", F.pmod(place(F.col("band"), F.col("lon")), columns))
    parts = home.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
    parts = parts.select("band", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    home = home.join(parts, ["band", "cell"], "left").select("id", "lon", "lat", "band", "cell", F.pmod(F.hash("id"), F.coalesce("parts", F.lit(1))).alias("part"))

    # half the width in degrees that the radius spans at the far side of the two bands a visitor looks at
    far = F.greatest(*[F.abs((F.col("band") + k) * height - 90.0) for k in (0, 2)])
    ratio = math.sin(radius_km / earth_km) / F.greatest(F.cos(F.radians(F.least(far, F.lit(90.0)))), F.lit(1e-12))
    span = F.when(ratio >= 1.0, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.0000001)
    visits = pts.withColumn("span", span).withColumn("to_band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    columns = _band_columns(F.col("to_band"), height, radius_km, earth_km)
    visits = visits.withColumn("n", columns).withColumn("low", place(F.col("to_band"), F.col("lon") - F.col("span"))).withColumn("high", place(F.col("to_band"), F.col("lon") + F.col("span")))
    all_around = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    some = F.array_distinct(F.transform(F.sequence("low", "high"), lambda c: F.pmod(c, F.col("n"))))
    cells = F.when(F.col("high") - F.col("low") + 1 >= F.col("n"), all_around).otherwise(some)
    visits = visits.select("id", "lon", "lat", "band", "to_band", F.explode(cells).alias("cell"))
    visits = visits.join(parts.select(F.col("band").alias("to_band"), "cell", "parts"), ["to_band", "cell"], "left")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    v = visits.select("cell", "part", F.col("to_band").alias("band"), F.col("id").alias("v_id"), F.col("lon").alias("v_lon"), F.col("lat").alias("v_lat"), F.col("band").alias("v_band"))
    pairs = home.join(v, ["band", "cell", "part"])
    pairs = pairs.where((F.col("v_band") < F.col("band")) & (F.col("v_id") != F.col("id")) | (F.col("v_band") == F.col("band")) & (F.col("v_id") < F.col("id")))
    # a chord test first: no trigonometry for most of the pairs that are too far
    pairs = pairs.where(F.abs(F.col("lat") - F.col("v_lat")) <= height)
    pairs = pairs.withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("v_lon"), F.col("v_lat"), earth_km)).where(F.col("km") <= radius_km)
    out = pairs.select(F.least("id", "v_id").alias("id_a"), F.greatest("id", "v_id").alias("id_b"), "km")
    return out


def nearest_of_sets(sets: DataFrame, lons: str, lats: str, out: str, earth_km: float = EARTH_KM) -> DataFrame:
    """Add ``out``: the smallest distance in km between two of the points in the arrays ``lons`` and ``lats`` of a row.

    A sweep by latitude that stops looking ahead at the best distance so far; no pairs are written out. Points without a
    position are left out; with fewer than two left the result is null. A row's arrays are bounded by the row.
    """

    @F.pandas_udf("double")
    def closest(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            if a is None or b is None or len(a) != len(b):
                out.append(None)
                continue
            a, b = np.asarray(a, float), np.asarray(b, float)
            ok = (np.abs(a) <= 180) & (np.abs(b) <= 90) & ~((a == 0) & (b == 0))
            order = np.argsort(b[ok], kind="stable")
            lon, lat = np.radians(a[ok][order]), np.radians(b[ok][order])
            best = math.inf
            for i in range(len(lat) - 1):
                j = i + 1 + np.searchsorted(lat[i + 1 :], lat[i] + best / earth_km, side="right")
                if j > i + 1:
                    h = np.sin((lat[i + 1 : j] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[i + 1 : j]) * np.sin((lon[i + 1 : j] - lon[i]) / 2) ** 2
                    best = min(best, 2 * earth_km * math.asin(min(1.0, math.sqrt(float(h.min())))))
            out.append(None if math.isinf(best) else best)
        return pd.Series(out, dtype="float64")

    return sets.withColumn(out, closest(F.col(lons), F.col(lats)))


def points_in_regions(points: DataFrame, id_col: str, x: str, y: str, regions: DataFrame, region_id: str, ring: str, cell: float) -> DataFrame:
    """``(id, region)`` for each point in a polygon; ``ring`` is an array of structs ``x, y`` in the plane of the points.

    Regions are written to all grid cells of side ``cell`` that their bounding box touches, points to one, and what meets is
    checked by counting crossings of a ray. Points on a lower or left edge are inside, on an upper or right one outside, so
    regions that tile the plane hold each point once. Choose ``cell`` near the size of a region: then a region has a few
    cells and a cell a few regions. The points of a crowded cell are dealt out and its few regions copied to each part. A point
    given twice comes out twice; a region given in two rows too. Rings of fewer than three corners or with null corners, and points without finite
    coordinates, match nothing.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    pts = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    pts = pts.where(finite(F.col("px")) & finite(F.col("py")))
    pts = pts.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    reg = regions.select(F.col(region_id).alias("region"), F.col(ring).alias("ring")).where(F.size("ring") >= 3)
    reg = reg.where(~F.exists("ring", lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])))
    side = lambda axis, pick: F.floor(pick(F.transform("ring", lambda p: p[axis])) / cell)
    reg = reg.withColumn("cx", F.explode(F.sequence(side("x", F.array_min), side("x", F.array_max))))
    reg = reg.withColumn("cy", F.explode(F.sequence(side("y", F.array_min), side("y", F.array_max))))
    met = join_hot(pts, reg, ["cx", "cy"], "id")

    def crossing(k: Column) -> Column:
        p, q = F.element_at("ring", k), F.element_at("ring", F.when(k == F.size("ring"), 1).otherwise(k + 1))
        spans = (p["y"] <= F.col("py")) != (q["y"] <= F.col("py"))
        at = p["x"] + (F.col("py") - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"])
        return F.when(spans & (F.col("px") < at), 1).otherwise(0)

    crossings = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("ring")), crossing), F.lit(0), lambda s, c: s + c)
    # a point is in one cell and a region once in each, so no two rows are the same
    return met.where(crossings % 2 == 1).select("id", "region")
