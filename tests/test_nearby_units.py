from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridwright.operators.nearby import nearest_of_sets, points_in_regions, points_within
from gridwright.operators.units import factors_of, measurement_units, tile_units


def km(a, b):
    (x1, y1), (x2, y2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def brute(points, radius):
    ok = {i: p for i, p in points.items() if p[0] is not None and p[1] is not None and abs(p[0]) <= 180 and abs(p[1]) <= 90 and p != (0.0, 0.0)}
    return {(i, j) for i in ok for j in ok if i < j and km(ok[i], ok[j]) <= radius}


@pytest.mark.parametrize("radius, centre, spread, cells", [(0.5, (9.0, 52.0), 0.03, 2000), (0.5, (9.0, 52.0), 0.004, 7), (50.0, (180.0, -10.0), 1.5, 2000), (300.0, (0.0, 89.0), 180.0, 2000), (900.0, (30.0, -88.0), 90.0, 20)])
def test_points_within_against_all_pairs(spark, radius, centre, spread, cells):
    rnd = random.Random(7)
    points = {}
    for i in range(150):
        lon = centre[0] + rnd.uniform(-spread, spread)
        lat = min(90.0, max(-90.0, centre[1] + rnd.uniform(-1, 1) * min(spread, 12)))
        points[i] = ((lon + 180) % 360 - 180, lat)
    points[200], points[201], points[202], points[203] = points[0], (None, 52.0), (float("nan"), 1.0), (0.0, 0.0)
    points[204] = (9.0, 91.0)
    df = spark.createDataFrame([(i, *p, "x", 1) for i, p in points.items()], "tile_id long, lon double, lat double, band string, cell int")
    got = points_within(df, "tile_id", "lon", "lat", radius, cell_rows=cells).collect()
    pairs = {(r.id_a, r.id_b) for r in got}
    assert pairs == brute(points, radius) and len(got) == len(pairs)
    assert (0, 200) in pairs


def test_points_within_of_nothing(spark):
    df = spark.createDataFrame([], "tile_id long, lon double, lat double")
    assert points_within(df, "tile_id", "lon", "lat", 1.0).count() == 0
    with pytest.raises(ValueError):
        points_within(df, "tile_id", "lon", "lat", 0.0)


def test_nearest_of_sets(spark):
    rnd = random.Random(3)
    sets = [[(rnd.uniform(5, 6), rnd.uniform(50, 51)) for _ in range(n)] for n in (2, 3, 40, 1, 0)]
    df = spark.createDataFrame([(i, [p[0] for p in s], [p[1] for p in s]) for i, s in enumerate(sets)] + [(9, None, None)], "i int, x array<double>, y array<double>")
    got = {r.i: r.d for r in nearest_of_sets(df, "x", "y", "d").collect()}
    for i, s in enumerate(sets):
        want = min((km(a, b) for k, a in enumerate(s) for b in s[:k]), default=None)
        assert got[i] == (None if want is None else pytest.approx(want, abs=1e-9))
    assert got[9] is None


def test_points_in_regions_against_crossings(spark):
    rnd = random.Random(5)
    rings = {1: [(0, 0), (4, 0), (4, 4), (0, 4)], 2: [(4, 0), (8, 0), (6, 3)], 3: [(1, 1), (9, 1), (9, 9), (5, 2)], 4: [(0, 0), (1, 1)]}

    def inside(x, y, ring):
        hits = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                hits += 1
        return hits % 2 == 1

    points = {i: (rnd.uniform(-1, 10), rnd.uniform(-1, 10)) for i in range(200)} | {900: (4.0, 1.0), 901: (0.0, 0.0)}
    pts = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(999, None, 1.0), (998, float("inf"), 1.0)], "id long, x double, y double")
    reg = spark.createDataFrame([(k, [{"x": float(a), "y": float(b)} for a, b in ring]) for k, ring in rings.items()] + [(5, None)], "region int, ring array<struct<x:double,y:double>>")
    got = {(r.id, r.region) for r in points_in_regions(pts, "id", "x", "y", reg, "region", "ring", 2.5).collect()}
    assert got == {(i, k) for i, p in points.items() for k, ring in rings.items() if len(ring) >= 3 and inside(*p, ring)}


FACTORS = [("m", "m", 1.0), ("cm", "m", 0.01), ("km", "m", 1000.0), ("ft", "m", 0.3048), ("ruthe", "m", 3.7662), ("deg", "m", 111319.49079327358), ("px", "px", 1.0), ("screen_px", "px", 0.25), (None, "m", 2.0), ("zero", "m", 0.0)]


def factors(spark):
    return factors_of(spark.createDataFrame(FACTORS, "unit_code string, base_unit string, factor double"))


def test_tile_units_by_identities(spark):
    nan = float("nan")
    base = [(i, 1_000_000.0 + i, 6_800_000.0, 1_055_000.0 + i, 6_750_000.0, 5000, 11.0, "values in feet; pixel size in km", "3857", 0) for i in range(20)]  # the text is wrong
    special = [
        (100, 1000.0, 6800.0, 1055.0, 6750.0, 5000, 11.0, None, None, 0), (101, 1e6 / 0.3048, 6.8e6 / 0.3048, 1.055e6 / 0.3048, 6.75e6 / 0.3048, 5000, 1100.0, None, None, 0),
        (102, 9.0, 52.0, 9.4941, 51.7, 5000, 0.0000988, "Angaben in Meter", "EPSG:4326", 0), (103, 1000.0, 6800.0, None, None, 5000, None, "Koordinaten in km", None, 0),
        (104, nan, nan, nan, nan, 5000, 36.09, None, None, 0), (105, None, None, None, None, None, None, None, None, 0), (100, 1000.0, 6800.0, 1055.0, 6750.0, 5000, 11.0, None, None, 0),
    ]
    df = spark.createDataFrame(base + special, "record_id long, ul_x double, ul_y double, lr_x double, lr_y double, width_px int, pixel_width double, crs_provenance string, source_crs string, best int")
    got = tile_units(df, factors(spark)).collect()
    units = {(r.record_id, r.field_name): r.unit_code for r in got}
    assert len(units) == len(got)
    assert all(units[i, f] == "m" for i in range(20) for f in ("ul_x", "pixel_width"))
    assert units[100, "ul_x"] == "km" and units[100, "pixel_width"] == "m"
    assert units[101, "ul_x"] == "ft" and units[101, "pixel_width"] == "cm"
    assert units[102, "ul_x"] == units[102, "pixel_width"] == "deg"
    assert units[103, "ul_x"] == "km" and (103, "pixel_width") not in units
    assert (104, "ul_x") not in units and units[104, "pixel_width"] == "ft"
    assert not any(i == 105 for i, _ in units)
    value = {(r.record_id, r.field_name): r.base_value for r in got}
    assert value[101, "ul_x"] == pytest.approx(1e6) and value[102, "ul_x"] == pytest.approx(9.0 * 111319.49079327358)


def test_measurement_units_by_clicks_not_words(spark):
    rows = [
        (1, 0.0, 0.0, 3.0, 4.0, 5.0, "12.5", 2.5, 2.5, "foot", "contour interval in ft"), (2, 0.0, 0.0, 3.0, 4.0, 20.0, "1250", 2.5, 2.5, "metre", None), (3, 0.0, 0.0, 3.0, 4.0, 5.0, "41,01", 2.5, 2.5, "m", "ok"),
        (4, 0.0, 0.0, 3.0, 4.0, 5.0, "3.319 Ruthen", None, None, "metre", None), (5, 0.0, 0.0, 3.0, 4.0, 5.0, " ", 2.5, 2.5, None, None), (6, 0.0, 0.0, 3.0, 4.0, None, "0.0125km", 2.5, 2.5, None, None), (7, None, None, None, None, None, "12", None, None, None, None),
        (8, 0.0, 0.0, 3.0, 4.0, float("nan"), "broken", 2.5, 2.5, None, None), (1, 0.0, 0.0, 3.0, 4.0, 5.0, "12.5", 2.5, 2.5, "foot", "contour interval in ft"),
    ]
    df = spark.createDataFrame(rows, "measure_id long, click1_x_px double, click1_y_px double, click2_x_px double, click2_y_px double, width_px double, width_m string, pixel_size_x_m double, pixel_size_y_m double, crs_linear_unit string, note string")
    got = measurement_units(df.withColumn("usual", F.lit(9)), factors(spark)).collect()
    units = {(r.record_id, r.field_name): r.unit_code for r in got}
    assert units == {(1, "width_px"): "px", (1, "width_m"): "m", (2, "width_px"): "screen_px", (2, "width_m"): "cm", (3, "width_px"): "px", (3, "width_m"): "ft", (4, "width_px"): "px", (4, "width_m"): "ruthe", (5, "width_px"): "px", (6, "width_m"): "km", (7, "width_m"): "m"}
    assert {(r.record_id, r.field_name) for r in got if not r.unique} >= {(7, "width_m")}


def test_a_unit_added_to_the_table_counts(spark):
    more = factors_of(spark.createDataFrame([("m", "m", 1.0), ("mile", "m", 1609.344), ("px", "px", 1.0)], "unit_code string, base_unit string, factor double"))
    row = (1, 0.0, 0.0, 3.0, 4.0, 5.0, "0.0077671", 2.5, 2.5, None, None)
    df = spark.createDataFrame([row], "measure_id long, click1_x_px double, click1_y_px double, click2_x_px double, click2_y_px double, width_px double, width_m string, pixel_size_x_m double, pixel_size_y_m double, crs_linear_unit string, note string")
    got = {r.field_name: r for r in measurement_units(df, more).collect()}
    assert got["width_m"].unit_code == "mile" and got["width_m"].base_value == pytest.approx(12.5, rel=1e-3)


def test_units_of_nothing(spark):
    tiles = spark.createDataFrame([], "record_id long, ul_x double, ul_y double, lr_x double, lr_y double, width_px int, pixel_width double, crs_provenance string, source_crs string")
    assert tile_units(tiles, factors(spark)).count() == 0
