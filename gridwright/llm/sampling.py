"""A sample whose shares of each category match given targets, with floors, and a report of what could not be met.

Systematic unequal-probability sampling. Tasks that agree in all categories form a cell; raking the cells to the margins
gives each cell's inclusion probability. Within a run the tasks stand in a line, cells sorted by category and each cell at
random; every task takes a stretch as long as its probability, and a task is drawn where the line crosses an integer, counted
from one random start. Where a cell's stretch lies is a prefix sum over cells, and where a task's lies in it a rank that is
worked out across partitions. At last, draws are moved between cells, as many at once as help, until the floors are met and no
move brings the shares nearer to the targets; the size stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.keys import tile_key
from gridwright.operators.rank import hash_order, latest, rank_in_groups
from gridwright.operators.skew import join_hot
from gridwright.session import cut_lineage

FIELDS = ("class_id", "tile_shortname", "pass_type")
#: The category of whatever has no target in a field.
OTHER = "*"
RAKING_ROUNDS = 40


def category(field: Column | str, value: Column) -> Column:
    """One spelling for each category: sheets by key, classes by number, everything else trimmed and in lower case."""
    text = F.lower(F.trim(F.regexp_replace(value.cast("string"), "[ \t\r\n]", " ")))
    whole = F.coalesce(F.trim(value.cast("string")).try_cast("double").cast("bigint").cast("string"), text)
    sheet = F.coalesce(tile_key(value.cast("string")), text)
    name = F.lit(field) if isinstance(field, str) else field
    out = F.when(name == "tile_shortname", sheet).when(name == "class_id", whole).otherwise(text)
    return F.when(out != "", out)


def rake(counts: np.ndarray, keys: list[np.ndarray], targets: list[np.ndarray], size: float) -> np.ndarray:
    """Expected draws of each cell: margins as near the targets as the counts allow, sum ``min(size, all)``.

    ``keys[f]`` is the category number of each cell in field f; category 0 has no target and gets what the others leave.
    """
    goal = min(float(size), float(counts.sum()))
    named = np.ones(len(counts))
    for key in keys:
        named = np.where(key == 0, named * 1e-6, named)
    draws = counts * named
    if goal <= 0 or draws.sum() <= 0:
        return np.zeros(len(counts))
    wanted = []
    for key, target in zip(keys, targets):
        there = np.bincount(key, counts, minlength=len(target))
        aim = np.minimum(target, there)
        aim[0] = max(0.0, goal - aim[1:].sum())
        wanted.append(aim)
    for _ in range(RAKING_ROUNDS):
        for key, aim in zip(keys, wanted):
            now = np.bincount(key, draws, minlength=len(aim))
            with np.errstate(divide="ignore", invalid="ignore"):
                draws = draws * np.where(now > 0, aim / np.maximum(now, 1e-300), 1.0)[key]
            draws = np.minimum(draws, counts)
    for _ in range(60):  # bring the sum to the goal within the counts
        lack = goal - draws.sum()
        if abs(lack) < 1e-9 * max(goal, 1.0):
            break
        room = (counts - draws) * np.maximum(named, 1e-6) if lack > 0 else draws
        if room.sum() <= 0:
            room = counts - draws
            if room.sum() <= 0:
                break
        draws = np.clip(draws + lack * room / room.sum(), 0.0, counts)
    return draws


#: What a draw missing at a floor weighs, against one that a share is off its target.
FLOOR_WEIGHT = 1000.0


def repair(drawn: np.ndarray, counts: np.ndarray, keys: list[np.ndarray], floors: list[np.ndarray], aims: list[np.ndarray]) -> np.ndarray:
    """Move draws from cell to cell until no move lowers what the floors lack, or else the summed distance from the aims.

    The sum stays. Category 0 of a field has neither floor nor aim. A move takes as many draws as its gain holds for, so the
    number of moves depends on the number of categories, not on the size of the sample.
    """
    drawn = np.array(drawn, dtype=float)
    has = [np.bincount(k, drawn, minlength=len(f)).astype(float) for k, f in zip(keys, floors)]

    def cost(h: np.ndarray, floor: np.ndarray, aim: np.ndarray) -> np.ndarray:
        out = FLOOR_WEIGHT * np.maximum(0.0, floor - h) + np.abs(h - aim)
        out[0] = 0.0
        return out

    def corner(h: np.ndarray, floor: np.ndarray, aim: np.ndarray, step: int) -> np.ndarray:
        """Draws until the gain of a step up or down changes: to the next aim or floor, 1 at least."""
        ahead = [np.where((mark - h) * step >= 1, np.floor(np.abs(mark - h)), np.inf) for mark in (floor, aim)]
        return np.maximum(1.0, np.minimum(*ahead))

    if not len(drawn):
        return drawn
    for _ in range(20 * sum(map(len, floors)) + 200):
        gives, takes = drawn > 0, drawn < counts
        if not gives.any() or not takes.any():
            break
        a, b = np.flatnonzero(gives), np.flatnonzero(takes)
        gain = np.zeros((len(a), len(b)))
        for k, h, f, g in zip(keys, has, floors, aims):
            now = cost(h, f, g)
            less, more = now - cost(h - 1, f, g), now - cost(h + 1, f, g)
            gain += np.where(k[a][:, None] == k[b][None, :], 0.0, less[k[a]][:, None] + more[k[b]][None, :])
        at = int(gain.argmax())
        if gain.flat[at] <= 1e-9:
            break
        x, y = int(a[at // len(b)]), int(b[at % len(b)])
        many = min(drawn[x], counts[y] - drawn[y])
        for k, h, f, g in zip(keys, has, floors, aims):
            if k[x] != k[y]:
                many = min(many, corner(h, f, g, -1)[k[x]] if k[x] else np.inf, corner(h, f, g, 1)[k[y]] if k[y] else np.inf)
        many = max(1.0, np.floor(many))
        drawn[x] -= many
        drawn[y] += many
        for k, h in zip(keys, has):
            h[k[x]] -= many
            h[k[y]] += many
    return drawn


def fill(drawn: np.ndarray, counts: np.ndarray, size: float) -> np.ndarray:
    """Draws raised or lowered to the sum ``size``, or to all there is, in the order of the cells."""
    drawn = np.array(drawn, dtype=float)
    for change in (counts - drawn, -drawn):
        lack = min(size, counts.sum()) - drawn.sum()
        if lack * change.sum() > 0:
            upto = np.clip(np.cumsum(np.abs(change)), 0, abs(lack))
            drawn += np.sign(lack) * np.diff(np.concatenate([[0.0], upto]))
    return drawn


def random_start(seed: int, run: object) -> float:
    digest = hashlib.sha256(f"{seed}|{run}".encode()).digest()
    return int.from_bytes(digest[:6], "big") / 2**48


def prepared(tasks: DataFrame) -> DataFrame:
    """One row for each task_key, the last delivered, with its categories; null keys aren't tasks."""
    last = latest(tasks.select("task_key", "run_id", *FIELDS, "recorded_at", "ingested_at"), "task_key", ["ingested_at", "recorded_at"])
    return last.select("task_key", "run_id", *[category(f, F.col(f)).alias(f) for f in FIELDS])


def cells_and_report(tasks: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(coded tasks, cells, report)``.

    The cells of a run are bounded by its targets, so raking and repair see some hundreds of rows for a run of any size.
    """
    goals = targets.select("run_id", "field_name", "category", category(F.col("field_name"), F.col("category").cast("string")).alias("key"),
                           F.coalesce("target_pct", F.lit(0)).cast("double").alias("pct"), F.coalesce("min_count", F.lit(0)).cast("long").alias("floor"),
                           F.coalesce("sample_size", F.lit(0)).cast("long").alias("size")).where(F.col("run_id").isNotNull())
    known = goals.groupBy("run_id").agg(*[F.collect_set(F.when(F.col("field_name") == f, F.col("key"))).alias(f"{f}_known") for f in FIELDS])
    # the runs' sizes are counted before delivery is sorted out; a hot run's few rows of targets are copied, the others aren't
    sizes = tasks.where("run_id is not null and task_key is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("_rows"))
    coded = join_hot(prepared(tasks).where(F.col("run_id").isNotNull()), known, ["run_id"], "task_key", sizes=sizes)
    coded = coded.select("run_id", "task_key", *[F.when(F.array_contains(f"{f}_known", F.col(f)), F.col(f)).otherwise(F.lit(OTHER)).alias(f) for f in FIELDS])
    counts = coded.groupBy("run_id", *FIELDS).agg(F.count(F.lit(1)).alias("there"))

    def solve(key: tuple, cells: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        columns = ["run_id", "kind", *FIELDS, "there", "start", "expected", "first_drawn", "drawn", "category", "target_pct", "min_count", "sample_size", "required", "selected", "status", "run_drawn"]
        if wanted.empty:
            return pd.DataFrame(columns=columns)
        size = float(wanted["size"].max())
        cells = cells.sort_values(list(FIELDS), kind="stable").reset_index(drop=True)
        counts = cells["there"].to_numpy(dtype=float)
        codes, targets, floors, names = [], [], [], []
        for f in FIELDS:
            mine = wanted[(wanted["field_name"] == f) & wanted["key"].notna()].groupby("key", sort=True).agg(pct=("pct", "sum"), floor=("floor", "max"))
            place = {k: i for i, k in enumerate(mine.index, 1)}
            code = np.array([place.get(v, 0) for v in cells[f]], dtype=np.int64)
            there = np.bincount(code, counts, minlength=len(place) + 1)
            floor = np.minimum(np.concatenate([[0], mine["floor"].to_numpy(dtype=float)]), there)
            codes.append(code)
            floors.append(floor)
            targets.append(np.maximum(np.concatenate([[0], size * mine["pct"].to_numpy(dtype=float) / 100]), floor))
            names.append(place)
        expected = rake(counts, codes, targets, size)
        ends = np.cumsum(expected)
        total = round(float(ends[-1])) if len(ends) else 0
        if len(ends):
            ends[-1] = total
        starts = np.concatenate([[0.0], ends[:-1]])[: len(ends)]
        u = random_start(seed, key[0])
        first = np.floor(ends + u) - np.floor(starts + u)
        drawn = repair(fill(np.minimum(first, counts), counts, size), counts, codes, floors, targets)
        out = cells.assign(run_id=key[0], kind="cell", start=starts + u, expected=ends - starts, first_drawn=first, drawn=drawn)
        lines = []
        for w in wanted.itertuples(index=False):
            f = FIELDS.index(w.field_name) if w.field_name in FIELDS else None
            code = None if f is None else names[f].get(w.key)
            there = 0.0 if code is None else float(counts[codes[f] == code].sum())
            chosen = 0.0 if code is None else float(drawn[codes[f] == code].sum())
            required = max(float(w.floor), w.size * w.pct / 100)
            status = "short" if there < required else "met" if abs(chosen - required) < 1 else "conflict"
            lines.append({"run_id": key[0], "kind": w.field_name, "category": w.category, "target_pct": w.pct, "min_count": w.floor, "sample_size": w.size, "there": there, "required": required, "selected": chosen, "status": status, "run_drawn": float(drawn.sum())})
        return pd.concat([out, pd.DataFrame(lines)], ignore_index=True).reindex(columns=columns)

    schema = "run_id bigint, kind string, class_id string, tile_shortname string, pass_type string, there double, start double, expected double, first_drawn double, drawn double, category string, target_pct double, min_count double, sample_size double, required double, selected double, status string, run_drawn double"
    # by number: the runs are small on the wire but cost time, so they aren't to be put together in a few tasks
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = counts.repartition(parts, "run_id").groupBy("run_id").cogroup(goals.repartition(parts, "run_id").groupBy("run_id")).applyInPandas(solve, schema)
    solved = cut_lineage(solved)
    cells = solved.where("kind = 'cell'").select("run_id", *FIELDS, "there", "start", "expected", "first_drawn", "drawn")
    report = solved.where("kind <> 'cell'").select(
        "run_id", F.col("kind").alias("field_name"), "category", "target_pct", F.col("min_count").cast("long").alias("min_count"), F.col("sample_size").cast("long").alias("sample_size"),
        "required", F.col("there").cast("long").alias("available"), F.col("selected").cast("long").alias("selected"),
        (F.col("there") < F.col("required")).alias("short"), F.greatest(F.lit(0.0), F.col("required") - F.col("selected")).alias("missing"),
        "status", F.col("run_drawn").cast("long").alias("run_drawn"),
    )
    return coded, cells, report


def sample(tasks: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(drawn tasks, report)``.

    drawn: ``run_id, task_key, class_id, tile_shortname, pass_type``, the category * for what has no target. report: each
    row of ``targets`` with the tasks available and selected, ``short`` where there are fewer tasks than the larger of the
    floor and the share of the size, ``missing``, by how many the sample misses that, ``status`` and ``run_drawn``, the size of
    the run's sample. status is short, met (within one draw) or conflict: there are enough tasks, but the draws that the other
    targets need don't leave room, and no move of draws brings the run's targets nearer in sum. The sample is never larger
    than the size, floors or not, and smaller only where a run has fewer tasks. Runs without targets give no
    sample; runs without tasks an empty one, all their targets short. Null categories count as none, null target figures
    as 0, a null run as no run, null keys aren't tasks; a task delivered twice counts once. Categories are compared in one
    spelling. Cells that lack a target in some field are drawn only to fill the size. Empty tables give empty ones.
    """
    coded, cells, report = cells_and_report(tasks, targets, seed)
    ordered = coded.withColumn("_order", hash_order(F.col("task_key"), seed=seed))
    ranked = rank_in_groups(ordered, ["run_id", *FIELDS], "_order", ["task_key"], "_rank")
    # the cells know their sizes, so a hot one is dealt out without another count
    placed = join_hot(ranked, cells, ["run_id", *FIELDS], "task_key", sizes=cells.select("run_id", *FIELDS, "there"), rows="there")
    step = F.col("expected") / F.col("there")
    upto = lambda k: F.floor(F.col("start") + step * k)
    before, upon = upto(F.col("_rank")) - F.floor("start"), upto(F.col("_rank") + 1) - F.floor("start")
    # the last of a cell ends where the next begins, whatever rounding did to the product
    upon = F.when(F.col("_rank") + 1 == F.col("there"), F.col("first_drawn")).otherwise(F.least(upon, F.col("first_drawn")))
    before = F.least(before, F.col("first_drawn"))
    placed = placed.withColumn("_hits", upon - before).withColumn("_upon", upon)
    crossed = F.col("_hits") >= 1
    keep = F.when(crossed, F.col("_upon") <= F.col("drawn")).otherwise(F.col("_rank") + 1 - F.col("_upon") <= F.col("drawn") - F.col("first_drawn"))
    return placed.where(keep).select("run_id", "task_key", *FIELDS), report
