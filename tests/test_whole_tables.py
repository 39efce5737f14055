"""Queries that read whole tables, on small tables made here."""

from __future__ import annotations

from pathlib import Path
from statistics import median

import numpy as np
import pandas as pd
import pytest

from gridwright.operators import selection, uncertainty
from gridwright.plans import reports, tiles, trials


def test_median_curve_goes_to_the_longest_run(spark, tmp_path):
    values = {user: [(user * 37 + i * 53) % 101 / 10 for i in range(n)] for user, n in ((1, 3), (2, 24), (3, 31))}
    rows = [(user * 100 + i, user, "click", v, None) for user, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    want = {k: (sum(len(v) >= k for v in values.values()), round(median(max(v[:k]) for v in values.values() if len(v) >= k), 6)) for k in range(1, 32)}
    assert {r.position: (r.users, r.median_best) for r in trials.median_curve(spark, str(tmp_path)).collect()} == want


def test_enrich_variant_reads_all_tiles(spark, tmp_path):
    columns = "tile_id long, shortname string, longname string, city string, year int, lon double, lat double, quadrant string, ul_x double, ul_y double, lr_x double, lr_y double, image_path string"
    # no id is a multiple of 3; KDR_003B, KDR_004A and KDR_005 are absent
    tiles_of = [(1, "KDR_001", "Au"), (2, "KDR_001A", "Berg"), (4, "KDR_002A", "Celle"), (5, "KDR_003", "Dorf"), (7, "KDR_003A", "Eck"), (8, "KDR_004C", "Furt"), (10, "KDR_004B", None)]
    spark.createDataFrame([(i, s, None, c, *[None] * 9) for i, s, c in tiles_of], columns).write.parquet(str(tmp_path / "new_all_tiles.parquet"))
    records = [(1, "KDR_001A", None), (2, "kdr-002a.png", "nan"), (3, "KDR_003B", None), (4, "KDR_004A", ""), (5, "KDR_005", None), (6, "KDR_001", "Own"), (7, None, None)]
    spark.createDataFrame(records, "record_id long, shortname string, city string").write.parquet(str(tmp_path / "real_tiles_metadata.parquet"))
    got = {r.record_id: r.city for r in tiles.enrich_variant(spark, str(tmp_path)).collect()}
    assert got == {1: "Berg", 2: "Celle", 3: "Dorf", 4: "Furt", 5: None, 6: "Own", 7: None}


@pytest.mark.parametrize("block", [1, 40, 10_000])
def test_greedy_by_blocks_is_greedy(monkeypatch, block):
    monkeypatch.setattr(selection, "BLOCK", block)
    rng = np.random.default_rng(block)
    x, y = rng.uniform(0, 1e5, (2, 70))
    pool = selection.Pool(pd.DataFrame({"row_id": range(70), "features": list(rng.random((70, 5))), "center_x": x, "center_y": y, "minx": x - 500, "maxx": x + 500, "miny": y - 500, "maxy": y + 500, "year": rng.integers(1880, 1940, 70)}))
    weights, drawn = (0.4, 0.3, 0.3), rng.integers(0, 70, 70)
    for least, seeds in ((0.0, ()), (15.0, ()), (15.0, (7, 3)), (60.0, ())):
        d = pool.unified(*weights)
        want = selection.greedy(d.max() - d, 9, pool.edge_km(), least, seeds)
        got = selection.greedy_by_blocks(70, selection.unified_similarity(pool, weights), 9, lambda c: pool.edge_km([c])[0], least, seeds)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-8)
        d = d[np.ix_(drawn, drawn)]
        want = selection.greedy(d.max() - d, 9, pool.edge_km()[np.ix_(drawn, drawn)], least)
        assert selection.greedy_by_blocks(70, selection.unified_similarity(pool, weights, drawn), 9, lambda c: pool.edge_km([drawn[c]])[0, drawn], least)[0] == want[0]
    for dense, rows in ((1 - pool.cosine(), lambda r: 1 - pool.cosine(r)), (-pool.visual(), lambda r: -pool.visual(r))):
        assert selection.greedy_by_blocks(70, rows, 9)[0] == selection.greedy(dense, 9)[0]


def test_pools_beyond_20000_are_chosen_from(spark):
    pool = spark.range(20_001).selectExpr("id as row_id", "array(sin(id), cos(id), id % 7.0D) as features", "id * 37.0D % 90000 as center_x", "id * 91.0D % 80000 as center_y")
    pool = pool.selectExpr("*", "center_x - 500 as minx", "center_x + 500 as maxx", "center_y - 500 as miny", "center_y + 500 as maxy", "int(1880 + row_id % 60) as year")
    for mode in ("farthest", "thinning", "cosine"):
        got = selection.select(pool, spark.createDataFrame([(0, 0.4, 0.3, 0.3, 2, 20.0)], selection.SETTINGS), mode).collect()
        assert len({r.row_id for r in got}) == 2


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_reports_have_their_full_size(spark, monkeypatch):
    assert reports.bootstrap_selection(spark, "/root/testdata/sf0.001").count() == 200 and reports.K == 24
    asked, ensemble = [], uncertainty.ensemble
    monkeypatch.setattr(uncertainty, "ensemble", lambda *a, **k: (asked.append(k.get("members", 5)), ensemble(*a, **k))[1])
    reports.ensemble_uncertainty(spark, "/root/testdata/sf0.001")
    assert asked == [5]
