from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gridwright.operators import handoff, inference, objective, selection


def test_anchors_are_read_or_refused(spark):
    texts = ["0.2,0.8; 0.5,0.5", " ; 0,1 ;", "", None, "0.1", "0.1,0.2,0.3", "1.1,0", "x,y", "nan,0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", handoff.parse_anchors(F.col("t")).alias("a")).collect()
    got = {r.k: None if r.a is None else [(p.x, p.y) for p in r.a] for r in rows}
    assert got[0] == [(0.2, 0.8), (0.5, 0.5)] and got[1] == [(0.0, 1.0)] and all(got[k] is None for k in range(2, 9))
    assert handoff.default_anchors(2) == [(0.33, 0.33), (0.67, 0.67)] and handoff.default_anchors(11)[9:] == [(0.5, 0.5)] * 2


def test_disagreements_and_verdict(spark):
    told = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    found = spark.createDataFrame([("a", 1), ("b", 2), ("d", None)], "k string, v int")
    got = {r.k: r.status for r in handoff.disagreement(told, found, "k", ["v"]).collect()}
    assert got == {"b": "different", "c": "only_told", "d": "only_found"}
    kinds = spark.createDataFrame([("data",), ("policy",), ("data",)], "kind string")
    assert tuple(handoff.verdict(kinds).first()) == (0, 1, 2, 4) and handoff.verdict(kinds.limit(0)).first().exit_code == 0
    lists = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "y"), (2, "x"), (3, None)], "g int, i string")
    digests = {r.g: (r["items"], r.digest) for r in handoff.list_digest(lists, "g", "i").collect()}
    assert digests[1] == digests[2] and digests[1][0] == 2 and 3 not in digests


def test_queue_and_undo(spark):
    tasks = spark.createDataFrame([(1, 5, False), (1, 3, True), (1, 7, None), (1, 9, False)], "g int, t int, late boolean")
    got = {r.t: r.place for r in handoff.queue(tasks, "g", "t", F.col("late"), F.col("t") == 9).collect()}
    assert got == {9: 0, 5: 1, 7: 2, 3: 3}
    left = handoff.undo_last(spark.createDataFrame([(1, 1), (1, 2), (2, 5), (None, 7)], "g int, o int"), "g", "o")
    assert sorted((r.o for r in left.collect())) == [1, 7]


POOL = "row_id long, label int, year int, center_x double, center_y double, features array<double>"


def test_objective_of_a_half_filled_selection(spark):
    pool = spark.createDataFrame([(1, 0, 1914, 0.0, 0.0, [0.0, 0.0]), (2, 0, None, 3000.0, 4000.0, [3.0, 4.0]), (3, 1, 1900, 6000.0, 0.0, [0.0, 8.0])], POOL)
    chosen = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 1), (3, 2), (3, 3)], "config_id int, row_id long")
    targets = spark.createDataFrame([(1, 4), (2, 1), (3, 3)], "config_id int, k int")
    got = {r.config_id: r for r in objective.scored_selections(chosen, pool, targets).collect()}
    base = (5 + 8 + 5) / 3
    assert got[1].diversity_norm == pytest.approx(5 / base) and got[1].filled == 0.5 and got[1].infeasible
    assert got[1].objective_score == pytest.approx(got[1].objective_raw * 0.05) and got[3].objective_score == pytest.approx(1.0)
    assert got[1].wwi_percent == 100 and got[1].temporal_range == 0 and got[2].diversity_norm == 0 and got[2].spread_norm == 0
    with pytest.raises(ValueError):
        objective.normalised_objective(chosen, pool, 0, 0)
    wide = selection.with_years(pool, "features", "year", 1.0).orderBy("row_id").collect()
    assert [len(r.features) for r in wide] == [3, 3, 3] and wide[2].features[-1] == 0 and wide[0].features[-1] > wide[1].features[-1] > 0


def test_paired_endpoints_by_sign_flips(spark):
    rows = [(k, s, e, float(k) + (d if s == "b" else 0)) for e, d, n in (("one", 2.0, 1), ("same", 0.0, 4), ("up", 1.0, 5)) for k in range(n) for s in "ab"]
    df = spark.createDataFrame(rows + [(9, "a", "up", 1.0), (9, "b", "none", 1.0)], "pair int, scenario string, endpoint string, v double")
    got = {r.endpoint: r for r in inference.paired_endpoints(df, "pair", "scenario", "v", "a", "b", "endpoint").collect()}
    assert set(got) == {"one", "same", "up"} and math.isnan(got["one"].standardised)
    assert got["same"].standardised == 0 and got["same"].p_value == 1 and got["up"].standardised == math.inf and got["up"].p_value == 2 / 32
