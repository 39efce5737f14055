"""Varied subsets under a minimum distance: greedy facility location and its relatives.

A pool is one group of an Arrow kernel, so many settings run side by side, each a task. Up to ``DENSE`` candidates its distances
are held as a matrix; for more they are worked out anew for a block of rows at a time, in each round, with the same choice.
:func:`greedy_in_two_rounds` is quicker and approximate: parts of the pool choose their best and these compete.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators.pairs import check_weights
from gridwright.operators.rank import dense_rank_all

#: Candidates up to which the distances of all with all are held, and figures in a block of rows beyond that.
DENSE, BLOCK = 4_000, 8_000_000
ALL = slice(None)
_EARTH = 6371.0


class Pool:
    """Candidates as arrays, in the order of their ids."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("row_id", kind="stable").reset_index(drop=True)
        self.ids = rows["row_id"].to_numpy()
        self.features = np.stack(rows["features"].to_numpy()).astype(float) if len(rows) else np.empty((0, 0))
        self.xy = rows[["center_x", "center_y"]].to_numpy(dtype=float)
        self.box = rows[["minx", "maxx", "miny", "maxy"]].to_numpy(dtype=float) if "minx" in rows else None
        years = rows["year"].to_numpy(dtype=float)
        self.years = np.where(np.isnan(years), np.nanmedian(years) if (~np.isnan(years)).any() else 0.0, years)

    # Distances of some rows (all if not given) with all, or with the columns given.
    def visual(self, rows=ALL) -> np.ndarray:
        some = self.features[rows]
        square, own = (self.features**2).sum(1), (some**2).sum(1)
        out = np.sqrt(np.maximum(own[:, None] + square[None, :] - 2 * some @ self.features.T, 0.0))
        # differences of near vectors lose digits in this form; they are worked out anew
        for i, j in zip(*np.nonzero(out < 1e-3 * (1 + np.sqrt(own)[:, None]))):
            out[i, j] = math.sqrt(float(((some[i] - self.features[j]) ** 2).sum()))
        return out

    def cosine(self, rows=ALL) -> np.ndarray:
        length = np.linalg.norm(self.features, axis=1)
        unit = self.features / np.where(length == 0, 1.0, length)[:, None]
        return np.clip(1 - unit[rows] @ unit.T, 0.0, 1.0)

    def centre_km(self, rows=ALL, columns=ALL) -> np.ndarray:
        x, y = self.xy[:, 0], self.xy[:, 1]
        if len(x) and max(np.abs(x).max(), np.abs(y).max()) >= 1000:
            return np.hypot(x[rows][:, None] - x[columns][None, :], y[rows][:, None] - y[columns][None, :]) / 1000
        lon, lat = np.radians(x), np.radians(y)
        h = np.sin((lat[rows][:, None] - lat[columns][None, :]) / 2) ** 2 + np.cos(lat[rows])[:, None] * np.cos(lat[columns])[None, :] * np.sin((lon[rows][:, None] - lon[columns][None, :]) / 2) ** 2
        return 2 * _EARTH * np.arctan2(np.sqrt(np.clip(h, 0, 1)), np.sqrt(1 - np.clip(h, 0, 1)))

    def edge_km(self, rows=ALL) -> np.ndarray:
        gap = lambda low, high: np.maximum(np.maximum(low[rows][:, None] - high[None, :], low[None, :] - high[rows][:, None]), 0.0)
        return np.hypot(gap(self.box[:, 0], self.box[:, 1]), gap(self.box[:, 2], self.box[:, 3])) / 1000

    def gap_years(self, rows=ALL) -> np.ndarray:
        return np.abs(self.years[rows][:, None] - self.years[None, :])

    @cached_property
    def largest(self) -> list[float]:
        """The largest visual, spatial and temporal distance, by blocks of rows."""
        most = [0.0, 0.0, 0.0]
        for rows in blocks(np.arange(len(self.ids)), len(self.ids)):
            most = [max(m, float(d(rows).max())) for m, d in zip(most, (self.visual, self.centre_km, self.gap_years))]
        return most

    def unified(self, alpha: float, beta: float, gamma: float, rows=None) -> np.ndarray:
        check_weights(alpha, beta, gamma)
        parts = [d(ALL if rows is None else rows) for d in (self.visual, self.centre_km, self.gap_years)]
        most = [d.max() if d.size else 0.0 for d in parts] if rows is None else self.largest
        visual, km, years = (d / m if m > 0 else d for d, m in zip(parts, most))
        return alpha * visual + beta * km + gamma * years


def blocks(rows: np.ndarray, columns: int) -> Iterable[np.ndarray]:
    """``rows`` in blocks that hold about ``BLOCK`` figures with that many columns."""
    size = max(1, BLOCK // max(1, columns))
    return (rows[k : k + size] for k in range(0, len(rows), size))


def unified_similarity(p: Pool, weights: Sequence[float], drawn: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The unified similarity of some rows with all, of the candidates at the places ``drawn`` (all if not given)."""
    drawn = np.arange(len(p.ids)) if drawn is None else drawn
    distance = lambda rows: p.unified(*weights, rows=drawn[rows])[:, drawn]
    most = max((float(distance(rows).max()) for rows in blocks(np.arange(len(drawn)), len(drawn))), default=0.0)
    return lambda rows: most - distance(rows)


def greedy_by_blocks(n: int, similarity: Callable[[np.ndarray], np.ndarray], k: int, apart: Callable[[int], np.ndarray] | None = None, least_km: float = 0.0, seeds: Sequence[int] = ()) -> tuple[list[int], list[float]]:
    """The choice of :func:`greedy` from similarities that are given for a block of rows at a time, so none are held."""
    chosen: list[int] = []
    gains: list[float] = []
    best: np.ndarray | None = None
    open_ = np.ones(n, dtype=bool)
    first = list(dict.fromkeys(s for s in seeds if 0 <= s < n))[:k]
    while len(chosen) < min(k, n) and (len(chosen) < len(first) or open_.any()):
        seed = first[len(chosen)] if len(chosen) < len(first) else None
        c, gain = -1, -np.inf
        for rows in blocks(np.flatnonzero(open_) if seed is None else np.array([seed]), n):
            block = similarity(rows)
            sums = block.sum(1) if best is None else np.maximum(block - best[None, :], 0.0).sum(1)
            sums = np.round(sums, 9) if seed is None else sums
            at = int(sums.argmax())
            if sums[at] > gain:
                c, gain = int(rows[at]), float(sums[at])
        row = similarity(np.array([c]))[0]
        chosen.append(c)
        gains.append(gain)
        best = row.copy() if best is None else np.maximum(best, row)
        open_[c] = False
        if apart is not None and least_km > 0:
            open_[apart(c) < least_km] = False
    return chosen, gains


def greedy(similarity: np.ndarray, k: int, apart: np.ndarray | None = None, least_km: float = 0.0, seeds: Sequence[int] = ()) -> tuple[list[int], list[float]]:
    """Positions and gains of a facility-location choice.

    The candidate that adds most to the sum over all of their best similarity to the choice comes next; ties (to 9 digits)
    go to the lowest position. Candidates nearer than ``least_km`` to one chosen are out, and the choice ends early if none
    is left. Seeds come first, in their order; they aren't checked against each other.
    """
    n = len(similarity)
    chosen: list[int] = []
    gains: list[float] = []
    best: np.ndarray | None = None
    open_ = np.ones(n, dtype=bool)

    def take(c: int, gain: float) -> None:
        nonlocal best
        chosen.append(c)
        gains.append(gain)
        best = similarity[c].copy() if best is None else np.maximum(best, similarity[c])
        open_[c] = False
        if apart is not None and least_km > 0:
            open_[apart[c] < least_km] = False

    def gain_of(c: int) -> float:
        return float(similarity[c].sum() if best is None else np.maximum(similarity[c] - best, 0.0).sum())

    for s in list(dict.fromkeys(s for s in seeds if 0 <= s < n))[:k]:
        take(s, gain_of(s))
    while len(chosen) < min(k, n) and open_.any():
        all_gains = similarity.sum(1) if best is None else np.maximum(similarity - best[None, :], 0.0).sum(1)
        all_gains = np.where(open_, np.round(all_gains, 9), -np.inf)
        c = int(all_gains.argmax())
        take(c, float(all_gains[c]))
    return chosen, gains


def lazy_greedy(similarity: np.ndarray, k: int) -> tuple[list[int], list[float]]:
    """The same choice as :func:`greedy` without constraint, looking again only at candidates whose old gain leads."""
    n = len(similarity)
    queue = [(-round(float(g), 9), i, 0) for i, g in enumerate(similarity.sum(1))]
    heapq.heapify(queue)
    best: np.ndarray | None = None
    chosen: list[int] = []
    gains: list[float] = []
    while queue and len(chosen) < min(k, n):
        gain, i, known = heapq.heappop(queue)
        if known == len(chosen):
            chosen.append(i)
            gains.append(-gain)
            best = similarity[i].copy() if best is None else np.maximum(best, similarity[i])
        else:
            heapq.heappush(queue, (-round(float(np.maximum(similarity[i] - best, 0.0).sum()), 9), i, len(chosen)))
    return chosen, gains


def farthest_points(features: np.ndarray, k: int) -> list[int]:
    """Start at the vector with most spread among its figures, then always the one least like all chosen."""
    n = len(features)
    if n == 0:
        return []
    chosen = [int(np.round(features.var(axis=1), 9).argmax())]
    near = np.linalg.norm(features - features[chosen[0]], axis=1)
    while len(chosen) < min(k, n):
        near[chosen] = -1.0
        c = int(np.round(near, 9).argmax())
        chosen.append(c)
        near = np.minimum(near, np.linalg.norm(features - features[c], axis=1))
    return chosen


def thin(order: Iterable[int], km: Callable[[int, list[int]], np.ndarray], least_km: float | None, limit: int | None = None) -> list[int]:
    """Go through ``order`` and keep what is at least ``least_km`` from all kept; no bound if it is None."""
    kept: list[int] = []
    for i in order:
        if limit is not None and len(kept) >= limit:
            break
        if not kept or not least_km or (km(i, kept) >= least_km).all():
            kept.append(i)
    return kept


def adaptive_thin(order: Sequence[int], km: Callable[[int, list[int]], np.ndarray], least_km: float, k: int, step: float, floor: float = 0.0) -> tuple[list[int], float]:
    """Lower the distance by ``step`` until ``k`` are kept or the floor is reached."""
    while True:
        kept = thin(order, km, least_km, k)
        if len(kept) >= min(k, len(order)) or least_km <= floor:
            return kept, least_km
        least_km = max(floor, least_km - step)


SETTINGS = "config_id int, alpha double, beta double, gamma double, k int, least_km double"


def select(pool: DataFrame, settings: DataFrame, mode: str = "unified", seeds: Sequence[int] = (), metric: str = "edge") -> DataFrame:
    """``config_id, selection_rank, row_id, gain`` for each row of ``settings`` (columns ``SETTINGS``).

    mode: unified (weighted visual, spatial and temporal similarity), cosine or euclidean (negative distance, centres only),
    lazy (unified without constraint), farthest, thinning (rank order by id). metric: edge or centre. The pool is copied
    once for each setting; the copies are worked on in parallel. A copy's rows must fit a task's memory, their distances not:
    beyond ``DENSE`` rows they are worked out in blocks, which takes time by rows squared and ``k``.
    """
    rows = pool.select("row_id", "features", "center_x", "center_y", "minx", "maxx", "miny", "maxy", "year")
    both = settings.join(rows)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, p = group.iloc[0], Pool(group)
        k, least = int(first["k"]), float(first["least_km"])
        weights, n = [float(first[c]) for c in ("alpha", "beta", "gamma")], len(p.ids)
        km = p.edge_km if metric == "edge" and mode == "unified" else p.centre_km
        places = [int(np.searchsorted(p.ids, s)) for s in seeds if s in set(p.ids.tolist())]
        if mode == "farthest":
            chosen = farthest_points(p.features, k)
            gains = [0.0] * len(chosen)
        elif mode == "thinning":
            chosen = thin(range(n), lambda i, kept: p.centre_km([i], kept)[0], least, k)
            gains = [0.0] * len(chosen)
        elif n > DENSE:
            if mode in ("unified", "lazy"):
                similarity = unified_similarity(p, weights)
            else:
                similarity = (lambda rows: 1 - p.cosine(rows)) if mode == "cosine" else (lambda rows: -p.visual(rows))
            free = mode == "lazy"
            chosen, gains = greedy_by_blocks(n, similarity, k, None if free else (lambda c: km([c])[0]), least, () if free else places)
        else:
            if mode in ("unified", "lazy"):
                d = p.unified(*weights)
                similarity = d.max() - d
            else:
                similarity = 1 - p.cosine() if mode == "cosine" else -p.visual()
            chosen, gains = lazy_greedy(similarity, k) if mode == "lazy" else greedy(similarity, k, km() if least > 0 else None, least, places)
        return pd.DataFrame({"config_id": int(first["config_id"]), "selection_rank": range(len(chosen)), "row_id": p.ids[chosen], "gain": gains})

    return both.groupBy("config_id").applyInPandas(run, "config_id int, selection_rank int, row_id bigint, gain double")


def greedy_in_two_rounds(pool: DataFrame, k: int, parts: int, least_km: float = 0.0, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3) -> DataFrame:
    """A choice from a pool of any size: each of ``parts`` random parts chooses ``k``, then the chosen compete.

    The known two-round scheme for distributed submodular choice, within a constant factor of the best. A part's distances
    are held as a matrix. ``selection_rank, row_id, gain``, gains among the finalists.
    """
    spark = pool.sparkSession
    dealt = pool.withColumn("config_id", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = Pool(group)
        d = p.unified(alpha, beta, gamma)
        chosen, _ = greedy(d.max() - d, k, p.edge_km() if least_km > 0 else None, least_km)
        return pd.DataFrame({"row_id": p.ids[chosen]})

    finalists = pool.join(dealt.groupBy("config_id").applyInPandas(run, "row_id bigint"), "row_id", "left_semi")
    settings = spark.createDataFrame([(0, alpha, beta, gamma, k, least_km)], SETTINGS)
    return select(finalists, settings).drop("config_id")


def with_years(pool: DataFrame, features: str, year: str, weight: float, ratio: float = 0.025) -> DataFrame:
    """``pool`` with the year, from 0 to 1 over the pool, added to the features as often as ``ratio`` of their number says (once
    at least), scaled by ``weight`` and the deviation of all feature values. A null year is the median one; if all years are
    equal the added values are 0."""
    flat = pool.select(F.explode(features).alias("v")).agg(F.stddev_pop("v").alias("_sd"))
    middle = pool.agg(F.expr(f"percentile({year}, 0.5)").alias("_median"))
    known = pool.crossJoin(F.broadcast(middle)).withColumn("_year", F.coalesce(F.col(year).cast("double"), "_median"))  # one row
    ends = known.agg(F.min("_year").alias("_low"), F.max("_year").alias("_high")).crossJoin(flat)
    share = F.coalesce((F.col("_year") - F.col("_low")) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    times = F.greatest(F.lit(1), F.bround(F.size(features) * ratio).cast("int"))
    both = known.crossJoin(F.broadcast(ends))  # one row
    return both.withColumn(features, F.concat(features, F.array_repeat(share * weight * F.col("_sd"), times))).select(*pool.columns)


def core_and_cases(core: DataFrame, cases: DataFrame, key: str, rank: str, unseen_only: bool = False) -> DataFrame:
    """``key, selection_group, selection_rank``: the core without the cases, the cases behind it, ranked anew from 0.

    Keys are compared without regard to case. With ``unseen_only`` the core stays whole and only cases that it lacks are
    appended. Ties go by key. The ranks are prefix sums over buckets of the order, so no task holds all rows.
    """
    low = lambda df: df.select(F.lower(key).alias("_low")).distinct()
    if unseen_only:
        cases = cases.withColumn("_low", F.lower(key)).join(low(core), "_low", "left_anti")
    else:
        core = core.withColumn("_low", F.lower(key)).join(low(cases), "_low", "left_anti")
    both = core.select(key, F.lit("core").alias("selection_group"), F.lit(0).alias("_group"), F.col(rank).alias("_rank"))
    both = both.union(cases.select(key, F.lit("case"), F.lit(1), F.col(rank)))
    return dense_rank_all(both, ["_group", "_rank", key], "selection_rank").drop("_group", "_rank")


def pareto_front(df: DataFrame, key: str, largest: list[str], smallest: list[str] = ()) -> DataFrame:
    """Rows that no other row dominates: at least as good in all objectives and better in one.

    Equal rows all stay. A null or NaN is neither better nor worse than anything, so such rows dominate none and are
    dominated by none. Each partition first drops what its own rows dominate, then the survivors (for few objectives a
    small part of a large table) meet by an anti-join.
    """
    signs = {**dict.fromkeys(largest, 1.0), **dict.fromkeys(smallest, -1.0)}
    objectives = list(signs)
    plain = df.select(key, *[(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) * s).alias(c) for c, s in signs.items()])

    def local(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        kept = None
        for frame in frames:
            kept = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            v = kept[objectives].to_numpy(dtype=float)
            whole = ~np.isnan(v).any(axis=1)
            out = np.zeros(len(v), dtype=bool)
            order = np.flatnonzero(whole)[np.argsort(-v[whole].sum(1), kind="stable")]
            front = np.empty((0, v.shape[1]))
            for i in order:  # who dominates has a larger sum, so it has come before
                if len(front) and ((front >= v[i]).all(1) & (front > v[i]).any(1)).any():
                    out[i] = True
                else:
                    front = np.vstack([front, v[i]])
            kept = kept[~out].reset_index(drop=True)
        if kept is not None:
            yield kept

    candidates = plain.mapInPandas(local, plain.schema)
    a, b = candidates.alias("a"), candidates.alias("b")
    no_worse, better = F.lit(True), F.lit(False)
    for c in objectives:
        no_worse, better = no_worse & (F.col(f"b.{c}") >= F.col(f"a.{c}")), better | (F.col(f"b.{c}") > F.col(f"a.{c}"))
    winners = a.join(b, no_worse & better, "left_anti").select(f"a.{key}")
    return df.join(winners, key, "left_semi")
