from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwright.functions import geo, keys

NAMES = {
    "KDR_118": "KDR_118", " kdr_118a ": "KDR_118A", "KDR-007B": "KDR_007B", "KDR 033N": "KDR_033N", "kdr_085.PNG": "KDR_085", "KDR_O33D": "KDR_033D", "KDR_lO4AA": "KDR_104AA", "KDR_l1O": "KDR_110",
    "KDR_4F": "KDR_004F", "358AF": "KDR_358AF", "KDR293U": "KDR_293U", "666": "KDR_666", "C:\\scans\\KDR_580B.PNG": "KDR_580B", "./images/kdr_094a.png": "KDR_094A", "KDR_007A_Knawumsee_1894": "KDR_007A", "KDR-001_Bock": "KDR_001",
    "unbekannt": None, "nan": None, "": None, "Lodrumrode": None, "KDR": None, None: None, "Ilmenau_1900": None,
}


def test_tile_key(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string").withColumn("key", keys.tile_key(F.col("name")))
    assert {r.name: r.key for r in df.collect()} == NAMES


def test_clean_number_fold_decimal(spark):
    df = spark.createDataFrame([(" n/a ", float("nan"), "Räthlenstett_an der Wölpe", "1,5"), ("a b", 2.0, "RÄTHLENSTETT a. d.  Wölpe", "x"), (None, None, None, None)], "a string, b double, c string, d string")
    rows = df.select(keys.clean(F.col("a")).alias("a"), keys.number(F.col("b")).alias("b"), keys.fold(F.col("c")).alias("c"), keys.decimal(F.col("d")).alias("d")).collect()
    assert [r.a for r in rows] == [None, "a b", None]
    assert [r.b for r in rows] == [None, 2.0, None]
    assert rows[0].c == rows[1].c == "raethlenstett an der woelpe" and rows[2].c is None
    assert [r.d for r in rows] == [1.5, None, None]


def test_decomposed_umlauts_fold_like_composed_ones(spark):
    df = spark.createDataFrame([("Tißumbu\u0308ll",), ("Tißumb\u00fcll",)], "c string").select(keys.fold(F.col("c")).alias("c"))
    assert {r.c for r in df.collect()} == {"tissumbuell"}


def test_haversine_of_a_degree(spark):
    row = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("a"), geo.planar_or_haversine_km(F.lit(450000.0), F.lit(0.0), F.lit(451000.0), F.lit(0.0)).alias("b")).first()
    assert row.a == pytest.approx(111.195, rel=1e-4) and row.b == 1.0


def test_touching_rectangles_are_0_apart(spark):
    a = dict(zip(("minx", "maxx", "miny", "maxy"), map(F.lit, (0.0, 1000.0, 0.0, 1000.0))))
    b = dict(zip(("minx", "maxx", "miny", "maxy"), map(F.lit, (1000.0, 2000.0, 0.0, 1000.0))))
    c = dict(zip(("minx", "maxx", "miny", "maxy"), map(F.lit, (4000.0, 5000.0, 5000.0, 6000.0))))
    row = spark.range(1).select(geo.edge_km(a, b).alias("ab"), geo.edge_km(a, c).alias("ac")).first()
    assert row.ab == 0.0 and row.ac == pytest.approx(5.0)


def test_transverse_mercator(spark):
    x, y = geo.lonlat_to_utm(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(9.0, 0.0), (9.0, 50.0), (12.0, 50.0), (6.0, 50.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert rows[0].x == pytest.approx(500000, abs=1e-6) and rows[0].y == pytest.approx(0, abs=1e-6)
    assert rows[1].y == pytest.approx(5540847.0416 * 0.9996, abs=2e-3)  # the meridian's arc to 50 degrees on this ellipsoid
    assert rows[2].x - 500000 == pytest.approx(500000 - rows[3].x, abs=1e-6) and rows[2].y == pytest.approx(rows[3].y, abs=1e-6)


def test_mercator_round_trip(spark):
    x, y = geo.lonlat_to_mercator(F.lit(12.5), F.lit(51.25))
    lon, lat = geo.mercator_to_lonlat(x, y)
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert (row.lon, row.lat) == (pytest.approx(12.5, abs=1e-12), pytest.approx(51.25, abs=1e-12))
