"""Resampling and tests: bootstrap, exact paired tests, rank tests, effect sizes.

Replicates are rows: each is drawn and worked on by its own generator, seeded by the base seed and its number, so the result
doesn't depend on how many tasks there are. Samples in one kernel are bounded by being values of one endpoint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs up to which all sign flips are gone through; with more, the sign test is taken.
MOST_FLIPS = 20


def sign_test(deltas: Sequence[float]) -> float:
    """Exact two-sided p-value; zeros are left out, none left give 1."""
    plus, minus = sum(d > 1e-12 for d in deltas), sum(d < -1e-12 for d in deltas)
    n, k = plus + minus, min(plus, minus)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def sign_flip_test(deltas: Sequence[float]) -> float:
    """Exact two-sided p-value of the mean over all flips of signs; the sign test for more than ``MOST_FLIPS`` pairs."""
    d = np.asarray([x for x in deltas if x is not None and not math.isnan(x)], dtype=float)
    if len(d) == 0:
        return 1.0
    if len(d) > MOST_FLIPS:
        return sign_test(d)
    sums = np.zeros(1)
    for x in d:
        sums = np.concatenate([sums + x, sums - x])
    return float((np.abs(sums) >= abs(d.sum()) - 1e-12).mean())


def mann_whitney(a: Sequence[float], b: Sequence[float]) -> tuple[float, float]:
    """``(U, p)``, two-sided, by the normal approximation with ties and continuity; p is 1 if a side is empty or all equal."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, 1.0
    both = np.concatenate([a, b])
    _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks = (ends - (counts - 1) / 2)[inverse]
    u = float(ranks[:n].sum() - n * (n + 1) / 2)
    spread = n * m / 12 * ((n + m + 1) - (counts**3 - counts).sum() / max(1, (n + m) * (n + m - 1)))
    if spread <= 0:
        return u, 1.0
    z = max(0.0, abs(u - n * m / 2) - 0.5) / math.sqrt(spread)
    return u, math.erfc(z / math.sqrt(2))


def cohens_d(a: Sequence[float], b: Sequence[float]) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    if len(a) < 2 or len(b) < 2:
        return 0.0
    pooled = math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))
    return float((a.mean() - b.mean()) / pooled) if pooled > 0 else 0.0


#: A mean or deviation up to this is none.
NOTHING = 1e-12


def standardised_delta(mean: Column, deviation: Column, pairs: Column) -> Column:
    """Mean over deviation of paired differences; 0 for no difference at all, infinite for a constant one, NaN for one pair."""
    constant = F.when(mean > NOTHING, float("inf")).when(mean < -NOTHING, float("-inf")).otherwise(0.0)
    return F.when(pairs < 2, float("nan")).when(deviation > NOTHING, mean / deviation).otherwise(constant)


def paired_deltas(rows: DataFrame, key: str, scenario: str, value: str, first: str, second: str, *by: str) -> DataFrame:
    """``by, key, delta``: the value of the second scenario minus that of the first, for keys that have both; a key's several
    values of one scenario are averaged."""
    wide = rows.groupBy(*by, key).agg(F.avg(F.when(F.col(scenario) == first, F.col(value))).alias("_a"), F.avg(F.when(F.col(scenario) == second, F.col(value))).alias("_b"))
    return wide.where("_a is not null and _b is not null").select(*by, key, (F.col("_b") - F.col("_a")).alias("delta"))


def delta_summary(deltas: DataFrame, *by: str) -> DataFrame:
    """``by, pairs, mean_delta, median_delta, std_delta, standardised, direction`` of paired differences."""
    one = deltas.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.avg("delta").alias("mean_delta"), F.expr("percentile(delta, 0.5)").alias("median_delta"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("std_delta"))
    direction = F.when(F.col("mean_delta") > 0, "second").when(F.col("mean_delta") < 0, "first").otherwise("no_change")
    return one.withColumn("standardised", standardised_delta(F.col("mean_delta"), F.col("std_delta"), F.col("pairs"))).withColumn("direction", direction)


def paired_endpoints(rows: DataFrame, key: str, scenario: str, value: str, first: str, second: str, *by: str) -> DataFrame:
    """``by, pairs, mean_delta, std_delta, standardised, p_value``: second minus first scenario of equal keys, averaged within a key.

    p_value is that of the exact sign-flip test for up to ``MOST_FLIPS`` pairs, whose differences alone are gathered, and of
    the sign test, from two counts, for more.
    """
    deltas = paired_deltas(rows, key, scenario, value, first, second, *by)
    up, down = F.count_if(F.col("delta") > NOTHING), F.count_if(F.col("delta") < -NOTHING)
    counts = deltas.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), up.alias("_up"), down.alias("_down"))
    few = deltas.join(counts.where(F.col("_n") <= MOST_FLIPS).select(*by), list(by), "left_semi") if by else deltas.limit(MOST_FLIPS + 1)
    few = few.groupBy(*by).agg(F.array_sort(F.collect_list("delta")).alias("_few"))

    @F.pandas_udf("double")
    def p_value(ups: pd.Series, downs: pd.Series, all_of_few: pd.Series) -> pd.Series:
        out = []
        for u, d, few in zip(ups, downs, all_of_few):
            out.append(sign_flip_test(few) if few is not None and len(few) <= MOST_FLIPS else sign_test([1.0] * int(u) + [-1.0] * int(d)))
        return pd.Series(out, dtype="float64")

    both = delta_summary(deltas, *by).join(counts, list(by)).join(few, list(by), "left") if by else delta_summary(deltas).crossJoin(counts).crossJoin(few)
    return both.select(*by, "pairs", "mean_delta", "std_delta", "standardised", p_value("_up", "_down", "_few").alias("p_value"))


def bootstrap(rows: DataFrame, by: str, value: str, replicates: int, seed: int = 0, statistic: Callable[[np.ndarray], float] = np.mean) -> DataFrame:
    """``by, replicate, value``: the statistic of resamples with replacement. Values are gathered by group as an array of
    doubles, and the replicates of a group are split over rows, so many tasks share a group."""
    arrays = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_v"))
    reps = arrays.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    @F.pandas_udf("double")
    def draw(values: pd.Series, rep: pd.Series) -> pd.Series:
        out = []
        for v, r in zip(values, rep):
            v = np.asarray(v)
            rng = np.random.default_rng([seed, int(r)])
            out.append(float(statistic(v[rng.integers(0, len(v), len(v))])))
        return pd.Series(out, dtype="float64")

    return reps.select(by, "replicate", draw("_v", "replicate").alias("value"))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, count, mean, std, median, q025, q975``: the deviation of one value is 0."""
    return rows.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
                                 F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.025)").alias("q025"), F.expr(f"percentile({value}, 0.975)").alias("q975"))


def neighbour_ranks(met: DataFrame, i: str, j: str, distance: str) -> DataFrame:
    """Add ``rank`` from 1: how near ``j`` is to ``i``, ties by ``j``."""
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(i).orderBy(distance, j)))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """``ari`` of two labellings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    choose = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    one = cells.agg(choose("n").alias("both"), F.sum("n").alias("all"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(choose("n").alias("a"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(choose("n").alias("b"))
    row = one.crossJoin(left).crossJoin(right)  # one row each
    expected = F.col("a") * F.col("b") / (F.col("all") * (F.col("all") - 1) / 2)
    top = (F.col("a") + F.col("b")) / 2 - expected
    return row.select(F.when(top == 0, 1.0).otherwise((F.col("both") - expected) / F.when(top != 0, top)).alias("ari"))
