"""Designs and searches over weights: grids, low-discrepancy points, sensitivity, stages, a density-ratio sampler.

These run on the driver: they make some hundreds of settings, and the work for each setting is what Spark spreads.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np

#: Primitive polynomials and first direction numbers of a Sobol sequence for dimensions 2 to 8.
SOBOL = [(1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17))]


def simplex(points: np.ndarray) -> np.ndarray:
    """Rows scaled to sum 1; rows of zeros become equal weights."""
    points = np.asarray(points, dtype=float)
    total = points.sum(axis=1, keepdims=True)
    return np.where(total > 0, points / np.where(total > 0, total, 1.0), 1.0 / points.shape[1])


def latin_hypercube(n: int, d: int, seed: int) -> np.ndarray:
    """One point in each of n strata of every dimension."""
    rng = np.random.default_rng(seed)
    return np.column_stack([(rng.permutation(n) + rng.random(n)) / n for _ in range(d)])


def sobol(n: int, d: int) -> np.ndarray:
    """The first n points of a Sobol sequence, by Gray code, for up to 8 dimensions."""
    if not 1 <= d <= len(SOBOL) + 1:
        raise ValueError(f"1 to {len(SOBOL) + 1} dimensions")
    bits = 32
    out = np.zeros((n, d))
    for k in range(d):
        v = np.zeros(bits, dtype=np.uint64)
        if k == 0:
            v[:] = [1 << (bits - 1 - i) for i in range(bits)]
        else:
            s, a, m = SOBOL[k - 1]
            for i in range(bits):
                if i < s:
                    v[i] = np.uint64(m[i] << (bits - 1 - i))
                else:
                    x = int(v[i - s]) ^ (int(v[i - s]) >> s)
                    for j in range(1, s):
                        if a >> (s - 1 - j) & 1:
                            x ^= int(v[i - j])
                    v[i] = np.uint64(x)
        x = 0
        for i in range(1, n):
            x ^= int(v[(i & -i).bit_length() - 1])
            out[i, k] = x / 2**bits
    return out


def centred_discrepancy(points: np.ndarray) -> float:
    """Centred L2 discrepancy of points in the unit cube."""
    x = np.asarray(points, dtype=float)
    n, d = x.shape
    away = np.abs(x - 0.5)
    one = np.prod(1 + 0.5 * away - 0.5 * away**2, axis=1).sum()
    two = np.prod(1 + 0.5 * away[:, None, :] + 0.5 * away[None, :, :] - 0.5 * np.abs(x[:, None, :] - x[None, :, :]), axis=2).sum()
    return float((13 / 12) ** d - 2 / n * one + two / n**2)


def weight_grid(step: float = 0.1, least: float = 0.01) -> list[tuple[float, float, float]]:
    """All weights on a grid that leave more than ``least`` for the third."""
    n = round(1 / step)
    out = []
    for i in range(1, n):
        for j in range(1, n):
            third = round(1 - i * step - j * step, 3)
            if third > least:
                out.append((round(i * step, 3), round(j * step, 3), third))
    return out


def sensitivity_grid(weights: tuple[float, float, float], p: float) -> list[tuple[float, float, float]]:
    """Each weight changed by p and p/2 up and down, the three then scaled to sum 1; the unchanged weights come first."""
    out = [weights]
    for k in range(3):
        for change in (-p, -p / 2, p / 2, p):
            w = list(weights)
            w[k] = max(0.0, w[k] * (1 + change))
            total = sum(w)
            if total > 0:
                out.append(tuple(round(v / total, 9) for v in w))
    return out


def fine_grid() -> list[tuple[float, float, float]]:
    """The default weights of the fine sweep: much visual, little spatial weight, the rest temporal, if that leaves any."""
    grid = [(a / 100, b / 100, round(1 - a / 100 - b / 100, 3)) for a in range(55, 80, 5) for b in range(5, 25, 5)]
    return [w for w in grid if w[2] > 0.01]


def ablation_scenarios(weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> dict[str, tuple[float, float, float]]:
    """Equal weights on each non-empty set of the three parts, and the weights in use."""
    parts, out = ("visual", "spatial", "temporal"), {}
    for size in (1, 2, 3):
        for used in combinations(range(3), size):
            name = "+".join(parts[k] for k in used) if size > 1 else f"{parts[used[0]]}_only"
            out[name] = tuple(1 / size if k in used else 0.0 for k in range(3))
    return out | {"trial_config": weights}


def corridor_stages(n: int, low: float = 0.04, high: float = 0.08, bounds: tuple[int, int] = (24, 96), step: int = 1, target: float | None = 0.05) -> list[int]:
    """Sizes of the stages: from one share of n to another (rounded half to even), in steps, kept within the bounds and n.

    ``target``, a share of n too, is one of the sizes, moved into the corridor. If the bounds cross, the lower gives way.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    most = min(bounds[1], n)
    first = max(1, min(most, round(n * low)))
    last = min(most, max(first, min(most, round(n * high))))
    first = min(max(first, min(bounds[0], most)), last)
    stages = set(range(first, last + 1, max(1, step)))
    if target is not None:
        stages.add(max(first, min(last, round(n * target))))
    return sorted(stages)


def trial_schedule(stages: int) -> list[int]:
    """Trials of each stage: few at first, then more; with many stages 320 in all, 8 each at least."""
    return [30, 40, 60, 80][: max(0, stages)] if stages <= 4 else [max(8, round(320 / stages))] * stages


def covers_all(k: int, n: int) -> bool:
    """Whether a stage selects the whole pool: it is a diagnosis then, without a minimum distance."""
    return k >= n


def initial_samples(dimensions: int | None, n: int = 0) -> int:
    """2 D^2 and 20 at least; without dimensions, the root of n and 27 at least."""
    return max(2 * dimensions**2, 20) if dimensions else max(27, math.isqrt(n))


def narrow(best: float, width: float = 0.2, low: float = 0.0, high: float = 1.0) -> tuple[float, float]:
    """Bounds around the best value for the next stage."""
    return max(low, best - width), min(high, best + width)


def density_ratio_search(evaluate: Callable[[list[np.ndarray]], list[float]], bounds: list[tuple[float, float]], batches: int, size: int, seed: int = 0, top: float = 0.25) -> tuple[np.ndarray, float, list[float]]:
    """Maximise by batches (tree-structured Parzen estimate): ``(best point, value, values in order)``.

    Half of the first batch is a Latin hypercube; later points are drawn around good ones, those where the density of good
    points is highest against that of the others come next. ``evaluate`` gets a whole batch, to be worked on in parallel.
    """
    rng = np.random.default_rng(seed)
    low, high = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    points: list[np.ndarray] = []
    values: list[float] = []
    for batch in range(batches):
        if batch == 0:
            new = list(low + latin_hypercube(size, len(bounds), seed) * (high - low))
        else:
            order = np.argsort(-np.array(values), kind="stable")
            cut = max(2, int(len(order) * top))
            good, rest = np.array(points)[order[:cut]], np.array(points)[order[cut:]]
            width = (high - low) * max(0.05, 0.5 / (batch + 1))
            drawn = np.clip(good[rng.integers(0, len(good), size * 8)] + rng.normal(size=(size * 8, len(bounds))) * width, low, high)
            density = lambda among: np.exp(-0.5 * (((drawn[:, None, :] - among[None, :, :]) / width) ** 2).sum(2)).mean(1) + 1e-12
            ratio = density(good) / (density(rest) if len(rest) else 1.0)
            new = list(drawn[np.argsort(-ratio, kind="stable")[:size]])
        values += evaluate(new)
        points += new
    best = int(np.argmax(values))
    return points[best], values[best], values
