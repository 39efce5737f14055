"""Raster patches as arrays: quality, connected pixels, drawn lines, and how widths change them."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pixel up to 70 is dark, from 245 white, up to 10 black.
DARK, WHITE, BLACK = 70, 245, 10


def patch_quality(pixels: np.ndarray) -> dict[str, float | str | bool]:
    """Spread, range, white and black shares, darkness of edge and centre of a grey patch, and whether it is good.

    The edge is a band of 12 per cent of the shorter side, the centre what 20 per cent leave on each side, 8 pixels at least
    both. A patch is rejected as blank if it hardly varies, as white or black if nearly all of it is, as dark_edge if its
    edge is dark and its centre isn't, as a legend makes it.
    """
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels.astype(float)
    if grey.size == 0:
        return {"std_gray": 0.0, "dynamic_range": 0.0, "white": 0.0, "black": 0.0, "edge_dark": 0.0, "center_dark": 0.0, "passed": False, "reason": "empty"}
    side = min(grey.shape)
    band, margin = max(8, int(side * 0.12)), max(8, int(side * 0.2))
    rim = np.ones(grey.shape, dtype=bool)
    rim[band : max(band, grey.shape[0] - band), band : max(band, grey.shape[1] - band)] = False
    centre = grey[margin : max(margin + 1, grey.shape[0] - margin), margin : max(margin + 1, grey.shape[1] - margin)]
    facts = {
        "std_gray": float(grey.std()), "dynamic_range": float(grey.max() - grey.min()), "white": float((grey >= WHITE).mean()), "black": float((grey <= BLACK).mean()),
        "edge_dark": float((grey[rim] <= DARK).mean()), "center_dark": float((centre <= DARK).mean()) if centre.size else 0.0,
    }
    reason = ""
    if facts["dynamic_range"] < 6 or facts["std_gray"] < 2:
        reason = "blank"
    elif facts["white"] > 0.995:
        reason = "white"
    elif facts["black"] > 0.995:
        reason = "black"
    elif facts["edge_dark"] > 0.22 and facts["center_dark"] < 0.04:
        reason = "dark_edge"
    return {**facts, "passed": reason == "", "reason": reason}


def check_patches(patches: DataFrame, key: str, pixels: str) -> DataFrame:
    """``key`` and the figures of :func:`patch_quality` for patches as arrays of rows of grey values, in Arrow batches."""
    schema = "std_gray double, dynamic_range double, white double, black double, edge_dark double, center_dark double, passed boolean, reason string"

    @F.pandas_udf(schema)
    def quality(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([patch_quality(np.array([np.asarray(r, float) for r in v]) if v is not None and len(v) else np.empty((0, 0))) for v in values])

    return patches.select(key, quality(F.col(pixels)).alias("q")).select(key, "q.*")


def count_components(mask: np.ndarray) -> int:
    """Groups of set pixels that touch by sides or corners."""
    left = mask.astype(bool).copy()
    found = 0
    for y, x in zip(*np.nonzero(left)):
        if not left[y, x]:
            continue
        found += 1
        queue = deque([(y, x)])
        left[y, x] = False
        while queue:
            cy, cx = queue.popleft()
            for ny in range(max(0, cy - 1), min(left.shape[0], cy + 2)):
                for nx in range(max(0, cx - 1), min(left.shape[1], cx + 2)):
                    if left[ny, nx]:
                        left[ny, nx] = False
                        queue.append((ny, nx))
    return found


def draw_line(points: list[tuple[float, float]], width: float, shape: tuple[int, int]) -> np.ndarray:
    """The pixels whose centre is at most half the width from a polyline."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]].astype(float) + 0.5
    mask = np.zeros(shape, dtype=bool)
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        dx, dy = bx - ax, by - ay
        long = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / long, 0, 1) if long > 0 else np.zeros(shape)
        mask |= np.hypot(x - ax - t * dx, y - ay - t * dy) <= width / 2
    return mask


def width_sensitivity(points: list[tuple[float, float]], width: float, shape: tuple[int, int]) -> list[dict[str, float]]:
    """Set pixels and their groups for the width and one more and less, with the differences to it."""
    out = []
    for change in (-1, 0, 1):
        mask = draw_line(points, max(1.0, width + change), shape)
        out.append({"width_px": max(1.0, width + change), "change": change, "foreground": int(mask.sum()), "components": count_components(mask)})
    base = out[1]
    return [{**r, "foreground_delta": r["foreground"] - base["foreground"], "component_delta": r["components"] - base["components"]} for r in out]


def anchor_on_line(points: list[tuple[float, float]], share: float, margin: float = 0.2) -> tuple[float, float]:
    """The point at a share of a polyline's length, kept from its ends by the margin."""
    share = min(max(share, margin), 1 - margin)
    legs = [float(np.hypot(b[0] - a[0], b[1] - a[1])) for a, b in zip(points, points[1:])]
    left = share * sum(legs)
    for (a, b), leg in zip(zip(points, points[1:]), legs):
        if left <= leg and leg > 0:
            return a[0] + (b[0] - a[0]) * left / leg, a[1] + (b[1] - a[1]) * left / leg
        left -= leg
    return points[-1]
