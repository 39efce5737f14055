from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridwright.operators import selection, skew
from gridwright.operators.rank import dense_rank_all

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("least", [10, 100_000])
def test_join_hot_is_a_join(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "LEAST_ROWS", least)
    big = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 97 = 1 THEN NULL ELSE id % 50 END AS k")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n"), (77, "z")], "k long, v string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()), key=repr)
        assert sorted(map(tuple, skew.join_hot(big, small, ["k"], "id", how).select("id", "k", "v").collect()), key=repr) == want
    hot = skew.hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "n")
    assert (hot is None) == (least > 600) and (hot is None or {r.k: r._parts for r in hot.collect()}[1] > 10)
    assert skew.join_hot(big.limit(0), small, ["k"], "id").count() == 0


def test_places_of_all_rows(spark):
    df = spark.createDataFrame([(k * 37 % 101, str(k)) for k in range(101)], "a long, b string").repartition(5)
    got = {r.a: r.place for r in dense_rank_all(df, ["a", "b"], "place").collect()}
    assert got == {k: k for k in range(101)}
    assert dense_rank_all(df.limit(0), ["a"], "place").count() == 0


def test_core_and_cases(spark):
    core = spark.createDataFrame([("KDR_1", 5), ("kdr_2", 1), ("KDR_3", 1)], "sheet string, r int")
    cases = spark.createDataFrame([("KDR_2", 9), ("KDR_9", 2)], "sheet string, r int")
    rows = lambda **k: {r.sheet: (r.selection_group, r.selection_rank) for r in selection.core_and_cases(core, cases, "sheet", "r", **k).collect()}
    assert rows() == {"KDR_3": ("core", 0), "KDR_1": ("core", 1), "KDR_9": ("case", 2), "KDR_2": ("case", 3)}
    assert rows(unseen_only=True) == {"KDR_3": ("core", 0), "kdr_2": ("core", 1), "KDR_1": ("core", 2), "KDR_9": ("case", 3)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_kernels_run_when_started_elsewhere(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from gridwright.session import local_session
print(e.entry(local_session(2, 2)).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) == 5, done.stderr[-2000:]
