from __future__ import annotations

import collections
import datetime

import numpy as np
from pyspark.sql import functions as F

from gridwright.llm import diverse, sampling

AT = datetime.datetime(2026, 1, 1)
TASKS = "task_key long, run_id long, class_id int, tile_shortname string, pass_type string, recorded_at timestamp_ntz, ingested_at timestamp_ntz, start int, there int"
GOALS = "run_id long, field_name string, category string, target_pct int, min_count int, sample_size int, short int"


def made(spark, rows, goals):
    tasks = spark.createDataFrame([(*r, AT, AT, 1, 1) for r in rows], TASKS)
    return tasks, spark.createDataFrame([(*g, 0) for g in goals], GOALS)


def test_shares_are_met_and_floors_repaired(spark):
    rows = [(i, 1, [0, 0, 0, 0, 0, 0, 0, 1, 1, 2][i % 10] if i != 777 else 3, "KDR_118" if i % 3 else " kdr_001.PNG", ["primary", " Repeat "][i % 2]) for i in range(2000)]
    goals = [(1, "class_id", "0", 50, 1, 100), (1, "class_id", "1", 30, 1, 100), (1, "class_id", "2", 20, 1, 100), (1, "class_id", "3", 0, 1, 100), (1, "tile_shortname", "KDR_118", 70, 2, 100), (1, "tile_shortname", "KDR_001", 30, 2, 100), (1, "pass_type", "PRIMARY", 40, 2, 100), (1, "pass_type", "repeat", 60, 2, 100)]
    drawn, report = sampling.sample(*made(spark, rows, goals))
    got = drawn.collect()
    assert len(got) == 100 and len({r.task_key for r in got}) == 100
    by = collections.Counter(r.class_id for r in got)
    assert abs(by["0"] - 50) <= 3 and abs(by["1"] - 30) <= 3 and abs(by["2"] - 20) <= 3 and by["3"] == 1
    assert abs(sum(r.tile_shortname == "KDR_118" for r in got) - 70) <= 3 and abs(sum(r.pass_type == "repeat" for r in got) - 60) <= 3
    lines = {(r.field_name, r.category): r for r in report.collect()}
    assert len(lines) == 8 and not any(r.short for r in lines.values())
    assert all(lines["class_id", c].selected == by[c] for c in "0123")
    again, _ = sampling.sample(*made(spark, rows, goals))
    assert {r.task_key for r in again.repartition(3).collect()} == {r.task_key for r in got}


def test_short_runs_nulls_and_repeats(spark):
    rows = [(1, 1, 0, "KDR_001", "primary"), (1, 1, 0, "KDR_001", "primary"), (2, 1, None, None, None), (3, 1, 9, "", "?"), (None, 1, 0, "KDR_001", "primary"), (4, None, 0, "KDR_001", "primary"), (5, 3, 0, "KDR_001", "primary")]
    goals = [(1, "class_id", "0", 100, 2, 10), (1, "pass_type", "primary", 100, 1, 1), (2, "class_id", "0", 100, 0, 10), (2, "class_id", "1", 0, 0, 10), (1, "tile_shortname", "KDR_001", None, None, None), (None, "class_id", "0", 1, 1, 1), (1, "other", "x", 1, 1, 10)]
    drawn, report = sampling.sample(*made(spark, rows, goals))
    assert {(r.run_id, r.task_key) for r in drawn.collect()} == {(1, 1), (1, 2), (1, 3)}
    lines = {(r.run_id, r.field_name, r.category): (r.available, r.short) for r in report.collect()}
    assert lines == {(1, "class_id", "0"): (1, True), (1, "pass_type", "primary"): (1, False), (2, "class_id", "0"): (0, True), (2, "class_id", "1"): (0, False), (1, "tile_shortname", "KDR_001"): (1, False), (1, "other", "x"): (0, True)}
    tasks, targets = made(spark, rows, goals)
    assert sampling.sample(tasks.limit(0), targets.limit(0))[0].count() == 0
    assert sampling.sample(tasks.limit(0), targets)[1].where("short").count() == 3 + 1


def test_hot_cell_draws_exactly_its_share(spark):
    rows = [(i, 1, 0 if i < 2900 else 1, "KDR_001", "primary") for i in range(3000)]
    goals = [(1, "class_id", "0", 37, 0, 200), (1, "class_id", "1", 63, 0, 200), (1, "tile_shortname", "KDR_001", 100, 0, 200), (1, "pass_type", "primary", 100, 0, 200)]
    drawn, report = sampling.sample(*made(spark, rows, goals))
    got = collections.Counter(r.class_id for r in drawn.collect())
    assert sum(got.values()) == 200 and got["1"] == 100  # there are only 100; the rest fills the size
    assert {r.category: r.short for r in report.where("field_name = 'class_id'").collect()} == {"0": False, "1": True}


def test_rake_and_repair_by_hand():
    counts, keys = np.array([10.0, 10.0, 80.0]), [np.array([1, 2, 0])]
    assert np.allclose(sampling.rake(counts, keys, [np.array([0.0, 6.0, 4.0])], 10), [6, 4, 0], atol=1e-3)
    assert np.allclose(sampling.rake(counts, keys, [np.array([0.0, 60.0, 4.0])], 30).sum(), 30)
    fixed = sampling.repair(np.array([5.0, 0.0, 5.0]), counts, keys, [np.array([0.0, 0.0, 2.0])], [np.array([0.0, 5.0, 2.0])])
    assert fixed.tolist() == [5.0, 2.0, 3.0]


def summed_miss(drawn, keys, targets):
    return sum(np.abs(np.bincount(k, drawn, minlength=len(t)) - t)[1:].sum() for k, t in zip(keys, targets))


def test_no_swap_lowers_the_miss_and_the_size_stays():
    rng = np.random.default_rng(5)
    for trial in range(25):
        cells, sizes = 40, (4, 7, 3)
        keys = [rng.integers(0, n, cells) for n in sizes]
        counts = rng.integers(0, [30, 3000][trial % 2], cells).astype(float)
        size = min(100 * [1, 100][trial % 2], counts.sum())
        targets = [np.concatenate([[0], size * rng.dirichlet(np.ones(n - 1))]) for n in sizes]
        floors = [np.minimum(rng.integers(0, 4, n), np.bincount(k, counts, minlength=n)) for k, n in zip(keys, sizes)]
        start = sampling.fill(np.floor(counts * size / counts.sum()), counts, size)
        got = sampling.repair(start, counts, keys, floors, targets)
        assert got.sum() == start.sum() == size and (got >= 0).all() and (got <= counts).all() and np.array_equal(got, np.floor(got))
        miss = summed_miss(got, keys, targets)
        lacks = lambda d: sum(np.maximum(0, f - np.bincount(k, d, minlength=len(f)))[1:].sum() for k, f in zip(keys, floors))  # noqa: B023, E731
        for a in np.flatnonzero(got > 0):
            for b in np.flatnonzero(got < counts):
                other = got.copy()
                other[a] -= 1
                other[b] += 1
                assert (lacks(other), summed_miss(other, keys, targets) + 1e-6) >= (lacks(got), miss)


def test_targets_that_contradict_each_other_are_named(spark):
    # every task of class 0 is on KDR_001, but class 0 is to be 80 per cent and KDR_001 20
    rows = [(i, 1, i % 2, ["KDR_001", "KDR_002"][i % 2], "primary") for i in range(400)]
    goals = [(1, "class_id", "0", 80, 0, 100), (1, "class_id", "1", 20, 0, 100), (1, "tile_shortname", "KDR_001", 20, 0, 100), (1, "tile_shortname", "KDR_002", 80, 0, 100), (1, "pass_type", "primary", 100, 0, 100)]
    drawn, report = sampling.sample(*made(spark, rows, goals))
    lines = report.collect()
    assert drawn.count() == 100 and {r.run_drawn for r in lines} == {100}
    assert not any(r.short for r in lines) and {r.status for r in lines if r.field_name == "pass_type"} == {"met"}
    assert sum(r.status == "conflict" for r in lines) >= 2
    # floors that add up to more than the size don't raise it
    goals = [(1, "class_id", "0", 50, 70, 100), (1, "class_id", "1", 50, 70, 100)]
    drawn, report = sampling.sample(*made(spark, rows, goals))
    assert drawn.count() == 100 and sorted(r.selected for r in report.collect())[0] >= 30


TILES = "tile_id long, year int, city string, lon double, lat double, draw string, cell int"
RECORDS = "record_id long, year double, city string, ul_x double, ul_y double, lr_x double, lr_y double, cell int"


def test_each_cell_before_any_cell_twice(spark):
    tiles = [(i, 1900, "Au", 9.0, 52.0, "", 0) for i in range(300)] + [(1000 + i, 1880 + 10 * i, "Berg", 7.0 + i, 50.0, "", 0) for i in range(5)] + [(None, 1900, "x", 1.0, 1.0, "", 0), (2000, None, None, float("nan"), None, "", 0), (2001, None, " ", 0.0, 0.0, "", 0)]
    records = [(1, 1905.0, "AU", 1001875.0, 6800125.0, 1001900.0, 6800000.0, 0), (2, float("nan"), "null", None, None, None, None, 0)]
    t, r = spark.createDataFrame(tiles, TILES), spark.createDataFrame(records, RECORDS)
    got = diverse.choose_varied(spark, t, r, size=9).collect()
    cells = collections.Counter(x.cell for x in got)
    assert len(got) == 9 and max(cells.values()) - min(cells.values()) <= 1 and [x.cell_rank for x in got] == sorted(x.cell_rank for x in got)
    everything = diverse.choose_varied(spark, t, r, size=10_000)
    assert everything.count() == 309 and everything.select("pool", "record_id").distinct().count() == 309
    ranks = everything.groupBy("cell").agg(F.max("cell_rank").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(x.m == x.n for x in ranks)
    assert diverse.choose_varied(spark, t.limit(0), r.limit(0)).count() == 0
