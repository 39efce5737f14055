from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import cluster, enrich, inference, objective, pairs, policy, raster, search, selection, splits, width
from gridwright.operators.components import connected_components
from gridwright.operators.rank import hash_order, latest, prefix_totals, rank_in_groups


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900)]
    got = connected_components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == union_find(edges) and len(got) == len(union_find(edges))


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_ranks_and_totals(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i, i % 5) for i in range(300)], "g int, id long, amount long").withColumn("o", hash_order(F.col("id"), seed=4))
    rows = rank_in_groups(df, ["g"], "o", ["id"], "r", buckets=8).collect()
    for g in (0, 1, 2, None):
        mine = sorted((r.o, r.r) for r in rows if r.g == g)
        assert [r for _, r in mine] == list(range(len(mine)))
    totals = sorted((r.o, r.amount, r.t) for r in prefix_totals(df, "o", ["id"], "amount", "t", buckets=8).collect())
    assert [t for _, _, t in totals] == list(itertools.accumulate((a for _, a, _ in totals), initial=0))[:-1]


def test_latest_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (2, None, "c"), (None, 9, "d")], "k long, at int, v string")
    assert {(r.k, r.v) for r in latest(df, "k", ["at"]).collect()} == {(1, "b"), (2, "c")}


def pool_of(spark, rows):
    return spark.createDataFrame(rows, "row_id long, features array<double>, center_x double, center_y double, minx double, maxx double, miny double, maxy double, year int")


def box(i, x, features=(0.0, 1.0), year=1900, half=500.0):
    return (i, list(features), x, 0.0, x - half, x + half, -half, half, year)


def test_touching_tiles(spark):
    pool = pool_of(spark, [box(1, 0.0), box(2, 1000.0, (1.0, 0.0))])
    for least, want in ((0.01, 1), (0.0, 2)):
        got = selection.select(pool, spark.createDataFrame([(0, 0.4, 0.3, 0.3, 2, least)], selection.SETTINGS)).collect()
        assert len(got) == want


def test_weights_must_sum_to_1():
    with pytest.raises(ValueError):
        pairs.check_weights(0.5, 0.5, 0.5)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    d = rng.random((30, 30))
    s = (d + d.T) / 2
    apart = np.abs(rng.random(30)[:, None] - rng.random(30)[None, :]) * 10
    apart = (apart + apart.T) / 2
    np.fill_diagonal(apart, 0)
    got, gains = selection.greedy(s, 6, apart, 1.0, seeds=(3,))
    want = [3]
    while len(want) < 6:
        best = np.max(s[want], axis=0)
        options = [(round(float(np.maximum(s[c] - best, 0).sum()), 9), -c) for c in range(30) if all(apart[c, q] >= 1.0 for q in want) and c not in want]
        if not options:
            break
        want.append(-max(options)[1])
    assert got == want and all(g >= h - 1e-9 for g, h in zip(gains[1:], gains[2:]))


def test_lazy_is_greedy_and_choices_are_prefixes():
    rng = np.random.default_rng(1)
    d = rng.random((60, 60))
    s = (d + d.T) / 2
    assert selection.lazy_greedy(s, 9) == selection.greedy(s, 9)
    assert selection.greedy(s, 5)[0] == selection.greedy(s, 9)[0][:5]


def test_thinning():
    x = np.array([0.0, 1, 2, 100, 101, 250])
    apart = lambda i, kept: np.abs(x[kept] - x[i])
    assert selection.thin(range(6), apart, 100.0) == [0, 3, 5]
    assert selection.thin(range(6), apart, None) == list(range(6))
    kept, least = selection.adaptive_thin(list(range(6)), apart, 100.0, 4, 50.0)
    assert (len(kept), least) == (4, 0.0) or len(kept) >= 4


def test_two_rounds_find_a_near_duplicate_once(spark):
    rows = [box(i, 10_000.0 * i, (math.cos(i / 9), math.sin(i / 9)), 1880 + i) for i in range(40)]
    got = selection.greedy_in_two_rounds(pool_of(spark, rows), 4, 3, least_km=20.0).collect()
    xs = sorted(10 * r.row_id for r in got)
    assert len(got) == 4 and all(b - a - 1 >= 20 for a, b in zip(xs, xs[1:]))


def test_skyline(spark):
    rnd = random.Random(2)
    rows = [(i, float(rnd.randrange(12)), float(rnd.randrange(12))) for i in range(80)] + [(90, None, 5.0), (91, float("nan"), 5.0)]
    got = {r.k for r in selection.pareto_front(spark.createDataFrame(rows, "k int, a double, b double"), "k", ["a"], ["b"]).collect()}
    known = [r for r in rows if r[0] < 90]
    want = {k for k, a, b in known if not any(c >= a and d <= b and (c > a or d < b) for _, c, d in known)} | {90, 91}
    assert got == want


def test_pairs_are_each_once(spark):
    df = spark.createDataFrame([(i, i * 1.0) for i in range(23)] + [(None, 1.0)], "k int, v double")
    got = [(r.k_a, r.k_b) for r in pairs.pairs(df, "k", ["v"], blocks=5).collect()]
    assert sorted(got) == [(a, b) for a in range(23) for b in range(a + 1, 23)]


@pytest.mark.parametrize("block_rows", [500, 4])
def test_distances_by_blocks(spark, block_rows):
    rng = np.random.default_rng(5)
    x = rng.random((17, 6))
    x[3] = x[4] + 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 6)], "k long, f array<double>")
    got = pairs.block_pairs(df, "k", ["f"], lambda a, b: {"d": pairs.euclidean_matrix(pairs.matrix(a["f"]), pairs.matrix(b["f"]))}, ["d"], block_rows).collect()
    assert sorted((r.i, r.j) for r in got) == [(i, j) for i in range(17) for j in range(i + 1, 17)]
    assert all(abs(r.d - np.linalg.norm(x[r.i] - x[r.j])) < 1e-12 for r in got)
    assert pairs.feature_pairs(df.limit(0), "k", ["f"]).count() == 0


def test_rules(spark):
    df = spark.createDataFrame([(1, "KDR_1", "a_Heide", 1890), (2, "KDR_2", None, None), (3, " kdr_3 ", "b", 1950)], "id int, short_name string, long_name string, year int")
    rules = {"constants": {"x": {"y": 1900}}, "rules": [
        {"id": "r1", "action": "exclude_from_candidate_pool", "match": {"short_name": "KDR_3"}}, {"id": "r2", "action": "flag_for_reporting", "match": {"year_lt_ref": "x.y"}},
        {"id": "r3", "action": "flag_for_reporting", "match": {"year_lt_ref": "x.z"}}, {"id": "r4", "action": "exclude_from_candidate_pool", "match": {}}]}
    kept, flags = policy.apply_policy(df, rules, "id")
    assert {r.id for r in kept.collect()} == {1, 2} and [(r.id, r.rule_id) for r in flags.collect()] == [(1, "r2")]
    with pytest.raises(ValueError):
        policy.compile_rule({"nonsense": 1}, {}, df.columns)


def test_fill_and_override(spark):
    base = spark.createDataFrame([(1, "KDR_155B", None), (2, "KDR_156", "x"), (3, "KDR_157", "n/a")], "id int, sheet string, city string")
    source = spark.createDataFrame([("KDR_155", "own"), ("KDR_155A", "other"), ("KDR_157", "y"), (None, "z")], "sheet string, city string")
    got = {r.id: r.city for r in enrich.fill_from_variant(base, source, "sheet", ["city"]).collect()}
    assert got == {1: "own", 2: "x", 3: "y"}
    assert {r.id: r.city for r in enrich.override(base, source, "sheet", "city").collect()} == {1: None, 2: "x", 3: "y"}


def test_four_tiles_are_two_components(spark):
    rows = [(i, x, x + 500.0, 0.0, 500.0) for i, x in ((1, 0.0), (2, 550.0), (3, 20000.0), (4, 20550.0))]
    df = spark.createDataFrame(rows, "id int, minx double, maxx double, miny double, maxy double")
    assert {r.id: r.component for r in splits.spatial_components(df, "id", 0.1).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert [r.violations for r in splits.leakage_audit(df.withColumn("s", F.when(F.col("id") % 2 == 0, "a").otherwise("b")), "id", "s", 0.1).collect()] == [2]


@pytest.mark.parametrize("cell", [0.5, 3.0, None])
def test_box_join_against_all_pairs(spark, cell):
    rnd = random.Random(9)
    rows = [(i, x := rnd.uniform(0, 20000), x + rnd.uniform(0, 3000), y := rnd.uniform(0, 20000), y + rnd.uniform(0, 3000)) for i in range(60)]
    gap = lambda a, b: math.hypot(max(a[1] - b[2], b[1] - a[2], 0), max(a[3] - b[4], b[3] - a[4], 0)) / 1000
    df = spark.createDataFrame([*rows, (99, None, 1.0, 1.0, 1.0)], "id int, minx double, maxx double, miny double, maxy double")
    got = [(r.a, r.b) for r in splits.boxes_within(df, "id", 1.2, cell).collect()]
    assert sorted(got) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and gap(a, b) < 1.2)


def test_folds_and_assignment(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1)) for _ in range(n)] + [(None,)], "g string")
    assert {r.g: r.fold for r in splits.grouped_folds(df, "g", 3).collect()} == {"a": 1, "b": 2, "c": 3, "d": 2}
    facts = spark.createDataFrame([(2, 40, "p", "q"), (1, 60, "p", "q"), (3, 14, "p", "q"), (4, 1, "r", "s")], "component long, size long, year_mode string, region_mode string")
    assert {r.component: r.split for r in splits.assign_components(facts).collect()} == {1: "train", 2: "val", 3: "test", 4: "test"}


def test_exact_tests():
    assert inference.sign_test([1, 1, 1, 1, 1, 0]) == pytest.approx(0.0625)
    assert inference.sign_test([]) == 1.0 and inference.sign_flip_test([]) == 1.0
    assert inference.sign_flip_test([0.0, 0.0]) == 1.0
    d = [0.3, -0.1, 0.4, 0.2, 0.5]
    flips = [abs(sum(x * s for x, s in zip(d, signs))) >= abs(sum(d)) - 1e-12 for signs in itertools.product((1, -1), repeat=5)]
    assert inference.sign_flip_test(d) == pytest.approx(sum(flips) / 32)
    u, p = inference.mann_whitney([1, 2, 3], [4, 5, 6, 6])
    assert u == 0.0 and 0.01 < p < 0.1
    assert inference.mann_whitney([1, 1], [1, 1])[1] == 1.0 and inference.cohens_d([1, 2, 3], [1, 2, 3]) == 0.0


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(30)], "g string, v double")
    one = inference.bootstrap(df.coalesce(1), "g", "v", 20, 5).orderBy("replicate").collect()
    assert one == inference.bootstrap(df.repartition(7), "g", "v", 20, 5).orderBy("replicate").collect()


def test_jaccard_and_rules(spark):
    df = spark.createDataFrame([([1, 2], [2, 1], 1.0), ([1], [2], 0.0), ([1, 2, 3], [2, 3, 4], 0.5), ([], [], 1.0), ([1], [], 0.0)], "a array<int>, b array<int>, want double")
    assert all(r.j == r.want for r in df.withColumn("j", objective.jaccard(F.col("a"), F.col("b"))).collect())
    assert objective.min_distance_rule(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "km double"), "km").first().median_km == 1.0
    assert objective.min_distance_rule(spark.createDataFrame([(1.0,)], "km double"), "km").first().median_km == 28.0
    trials = spark.createDataFrame([(1, 40, 1.0, True), (2, 34, 0.99, True), (3, 30, 0.965, True), (4, 20, 1.05, False)], "number int, n int, value double, feasible boolean")
    assert objective.plateau(trials).first().n == 34


def test_searches():
    assert search.sobol(4, 2).tolist() == [[0, 0], [0.5, 0.5], [0.75, 0.25], [0.25, 0.75]]
    x = search.latin_hypercube(16, 3, 1)
    assert all(sorted((x[:, k] * 16).astype(int)) == list(range(16)) for k in range(3))
    assert search.centred_discrepancy(search.sobol(64, 2)) < search.centred_discrepancy(np.random.default_rng(0).random((64, 2)))
    assert np.allclose(search.simplex(np.array([[1, 1, 2], [0, 0, 0.0]])).sum(1), 1)
    assert (search.initial_samples(3), search.initial_samples(5), search.initial_samples(None)) == (20, 50, 27)
    assert search.trial_schedule(9) == [36] * 9 and search.trial_schedule(3) == [30, 40, 60] and search.trial_schedule(0) == []
    assert search.corridor_stages(10) == [1] and search.corridor_stages(300) == [24] and search.corridor_stages(5000, step=20) == [96]
    assert len(search.fine_grid()) == 20 and search.fine_grid()[0] == (0.55, 0.05, 0.4) and search.covers_all(5, 5)
    stages = search.corridor_stages(676)
    assert (stages[0], stages[-1]) == (27, 54)
    best, value, values = search.density_ratio_search(lambda ps: [-float(((p - 0.3) ** 2).sum()) for p in ps], [(0, 1), (0, 1)], 6, 16, seed=2)
    assert value > -0.01 and len(values) == 96 and np.allclose(best, 0.3, atol=0.1)
    assert all(abs(sum(w) - 1) < 1e-6 for w in search.sensitivity_grid((0.4, 0.3, 0.3), 0.2)) and len(search.ablation_scenarios()) == 8


def test_rasters(spark):
    noise = np.random.default_rng(0).integers(0, 255, (64, 64))
    assert raster.patch_quality(noise)["passed"] and raster.patch_quality(np.full((64, 64), 255))["reason"] == "blank"
    # a dark rim counts if it leaves the centre free, a fifth of the side on each side
    for wide, reason in ((10, "dark_edge"), (16, "")):
        rim = np.full((64, 64), 200)
        rim[:wide], rim[-wide:], rim[:, :wide], rim[:, -wide:] = 0, 0, 0, 0
        assert raster.patch_quality(rim)["reason"] == reason
    sparse = np.full((100, 100), 250)
    sparse[0, :40] = 100
    assert [raster.patch_quality(p)["reason"] for p in (sparse, 255 - sparse)] == ["white", "black"]
    assert raster.patch_quality(np.full((64, 64), 100) + np.arange(64) % 5)["reason"] == "blank"
    df = spark.createDataFrame([(1, noise.tolist()), (2, None)], "k int, p array<array<int>>")
    assert {r.k: r.passed for r in raster.check_patches(df, "k", "p").collect()} == {1: True, 2: False}
    mask = np.zeros((5, 5), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 4] = True
    assert raster.count_components(mask) == 2
    rows = raster.width_sensitivity([(2, 8), (14, 8)], 3, (16, 16))
    assert rows[0]["foreground"] < rows[1]["foreground"] < rows[2]["foreground"] and rows[1]["foreground_delta"] == 0
    assert raster.anchor_on_line([(0, 0), (10, 0)], 0.0) == (2.0, 0.0)


def test_cluster_numbers_and_scaling(spark):
    rows = [(i, [float(i % 2) * 10, 1.0, 3.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, f array<double>")
    scaled = cluster.standardise(df, "f", 3)
    assert {tuple(round(v, 6) for v in r.scaled) for r in scaled.collect()} == {(-1.0, 0.0, 0.0), (1.0, 0.0, 0.0)}
    got, centres = cluster.kmeans(df, "row_id", "f", 2)
    assert {(r.row_id % 2, r.cluster) for r in got.collect()} == {(0, 0), (1, 1)} and centres[0][0] == 0.0


def test_turns_and_fallback(spark):
    df = spark.createDataFrame([(i, "A" if i < 12 else "B", 1) for i in range(15)], "k long, tile string, c int")
    got = width.by_turns(df, ["c"], "tile", F.col("k"), 5, "k").orderBy("place").collect()
    assert len(got) == 5 and sorted(r.tile for r in got) == ["A"] * 3 + ["B"] * 2 or sorted(r.tile for r in got) == ["A"] * 2 + ["B"] * 3
    attempts = spark.createDataFrame([("a", 0, False, "dark"), ("a", 1, True, None), ("b", 0, False, "blank"), ("b", 1, False, "dark"), ("c", 0, True, None)], "s string, i int, ok boolean, why string")
    rows = {r.s: (r.attempt, r.ok, r.replacement_reason) for r in width.with_fallback(attempts, "s", "i", "ok", "why").collect()}
    assert rows == {"a": (1, True, "dark"), "b": (1, False, "blank"), "c": (0, True, None)}
