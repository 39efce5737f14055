"""All pairs of a set, spread over tasks, and the distances between the two of a pair.

Rows are dealt to blocks; the pairs of two blocks are the work of one key of an equi-join. Each row is copied once for each
block, not once for each partner, and no task holds more than two blocks. The number of pairs is still quadratic, so this is
for pools and selections; for large tables use a range join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(df: DataFrame, key: str, columns: list[str], blocks: int = 8) -> DataFrame:
    """Each pair of different rows once, smaller key first: the columns with ``_a`` and ``_b`` behind. Null keys are left out."""
    rows = df.where(F.col(key).isNotNull()).select(key, *[c for c in columns if c != key])
    rows = rows.withColumn("_block", F.pmod(F.hash(key), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.withColumn("_other", other).withColumn("_pair", F.least("_block", "_other") * blocks + F.greatest("_block", "_other"))
    side = lambda s: rows.select("_pair", F.col("_block").alias(f"_block{s}"), *[F.col(c).alias(f"{c}{s}") for c in [key, *(c for c in columns if c != key)]])
    a, b = side("_a"), side("_b")
    # of two different blocks each side brings one; of a block with itself both come from it
    met = a.join(b, "_pair").where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    other_block = (F.col("_pair") == F.least("_block_a", "_block_b") * blocks + F.greatest("_block_a", "_block_b"))
    return met.where(other_block).drop("_pair", "_block_a", "_block_b")


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine, cut to 0..1; a vector of length 0 counts as length 1."""
    length = lambda v: F.when(norm(v) == 0.0, 1.0).otherwise(norm(v))
    return F.least(F.greatest(F.lit(1.0) - dot(a, b) / (length(a) * length(b)), F.lit(0.0)), F.lit(1.0))


def box(suffix: str) -> dict[str, Column]:
    return {c: F.col(f"{c}{suffix}") for c in ("minx", "maxx", "miny", "maxy")}


def check_weights(alpha: float, beta: float, gamma: float) -> None:
    """The weights of a unified distance must sum to 1."""
    if abs(alpha + beta + gamma - 1.0) > 1e-5:
        raise ValueError("alpha + beta + gamma must be 1")


def block_pairs(df: DataFrame, key: str, columns: list[str], kernel: Callable[[pd.DataFrame, pd.DataFrame], dict[str, np.ndarray]], names: list[str], block_rows: int = 500) -> DataFrame:
    """``i, j`` (i < j) and the matrices that ``kernel`` gives for all pairs of rows, block by block, in Arrow batches.

    For what built-in functions are slow at, such as distances of long vectors: a task gets two blocks of about
    ``block_rows`` rows and multiplies matrices. Null keys are left out; keys must be different.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), *[F.col(c) for c in columns])
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("_pair", F.least("_block", "_other") * blocks + F.greatest("_block", "_other"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = int(group["_block"].min())
        a = group[group["_block"] == first].sort_values("_key", kind="stable").reset_index(drop=True)
        b = group[group["_block"] != first].sort_values("_key", kind="stable").reset_index(drop=True)
        pair = int(group["_pair"].iloc[0])
        if pair // blocks == pair % blocks:
            b, (r, c) = a, np.triu_indices(len(a), 1)
        elif b.empty:  # one of the two blocks has no rows
            return pd.DataFrame({n: [] for n in ["i", "j", *names]})
        else:
            r, c = (x.ravel() for x in np.indices((len(a), len(b))))
        u, v = a["_key"].to_numpy()[r], b["_key"].to_numpy()[c]
        return pd.DataFrame({"i": np.minimum(u, v), "j": np.maximum(u, v), **{n: m[r, c] for n, m in kernel(a, b).items()}})

    schema = "i bigint, j bigint, " + ", ".join(f"{n} double" for n in names)
    return rows.groupBy("_pair").applyInPandas(run, schema)


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def euclidean_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices; those near 0, where the product form loses digits, by differences."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    out = np.sqrt(np.maximum(squares - 2 * a @ b.T, 0.0))
    for i, j in zip(*np.nonzero(out < 1e-3 * np.sqrt(squares + 1))):
        out[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum())
    return out


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1)) == 0, 1.0, n)[:, None]
    return np.clip(1 - unit(a) @ unit(b).T, 0.0, 1.0)


def feature_pairs(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``i, j`` and the Euclidean distance by each of the feature columns, under its name."""
    return block_pairs(df, key, features, lambda a, b: {f: euclidean_matrix(matrix(a[f]), matrix(b[f])) for f in features}, features)


def pool_pairs(pool: DataFrame) -> DataFrame:
    """``i, j`` and the raw distances: visual, cosine, spatial and edge in km, temporal in years; a missing year is the median one."""
    median = pool.agg(F.expr("percentile(year, 0.5)").alias("_median"))
    rows = pool.crossJoin(F.broadcast(median)).withColumn("year_known", F.coalesce("year", "_median").cast("double"))  # one row

    def distances(a: pd.DataFrame, b: pd.DataFrame) -> dict[str, np.ndarray]:
        apart = lambda c: a[c].to_numpy(dtype=float)[:, None] - b[c].to_numpy(dtype=float)[None, :]
        gap = lambda low, high: np.maximum(np.maximum(a[low].to_numpy()[:, None] - b[high].to_numpy()[None, :], b[low].to_numpy()[None, :] - a[high].to_numpy()[:, None]), 0.0)
        x, y = matrix(a["features"]), matrix(b["features"])
        return {"visual": euclidean_matrix(x, y), "cosine": cosine_matrix(x, y), "spatial_km": np.hypot(apart("center_x"), apart("center_y")) / 1000,
                "edge_km": np.hypot(gap("minx", "maxx"), gap("miny", "maxy")) / 1000, "years": np.abs(apart("year_known"))}

    columns = ["features", "center_x", "center_y", "minx", "maxx", "miny", "maxy", "year_known"]
    return block_pairs(rows, "row_id", columns, distances, ["visual", "cosine", "spatial_km", "edge_km", "years"])


def unified(raw: DataFrame, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3) -> DataFrame:
    """Add ``distance``: each part divided by its largest value, weighted. A part that is 0 everywhere stays 0."""
    check_weights(alpha, beta, gamma)
    most = raw.agg(*[F.max(c).alias(f"_{c}") for c in ("visual", "spatial_km", "years")])
    part = lambda c: F.coalesce(F.col(c) / F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")), F.lit(0.0))
    both = raw.crossJoin(F.broadcast(most))  # one row
    return both.withColumn("distance", part("visual") * alpha + part("spatial_km") * beta + part("years") * gamma).drop("_visual", "_spatial_km", "_years")


def mean_cosine_distance(df: DataFrame, features: str, width: int) -> DataFrame:
    """The mean of 1 - cosine over all pairs, without pairs: the sum of unit vectors says the sum of their products."""
    length = F.when(norm(features) == 0.0, 1.0).otherwise(norm(features))
    unit = df.select(F.transform(features, lambda v: v / length).alias("u")).withColumn("own", dot("u", "u"))
    sums = unit.agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("own"), F.array(*[F.sum(F.col("u")[k]) for k in range(width)]).alias("total"))
    crossed = (dot("total", "total") - F.col("own")) / 2
    count = F.col("n") * (F.col("n") - 1) / 2
    return sums.select("n", (1 - crossed / F.when(count > 0, count)).alias("mean_distance"))
