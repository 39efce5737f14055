"""Tasks and measurements of line widths: quotas, drawing by turns, repeats, robust summaries, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def width_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, n, median, iqr, mad, final_width_px, few, spread`` of kept measurements; the final width is the median rounded half to
    even. The deviations are taken from the group's median, which a second aggregation joins."""
    kept = rows.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    one = kept.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.75) - percentile({value}, 0.25)").alias("iqr"))
    apart = kept.join(F.broadcast(one.select(by, F.col("median").alias("_m"))), by).groupBy(by).agg(F.expr(f"percentile(abs({value} - _m), 0.5)").alias("mad"))  # one row a class
    out = one.join(apart, by)
    return out.select(by, "n", "median", "iqr", "mad", F.bround("median").cast("int").alias("final_width_px"), (F.col("n") < 5).alias("few"), (F.col("iqr") > 2).alias("spread"))


def repeat_differences(rows: DataFrame, run: str, task: str, repeat_of: str, value: str, by: str) -> DataFrame:
    """``by, repeats, median_difference``: of tasks that repeat another of the same run."""
    first = rows.select(F.col(run).alias("_run"), F.col(task).alias("_task"), F.col(value).alias("_first"))
    met = rows.where(F.col(repeat_of) != "").join(first, (F.col(run) == F.col("_run")) & (F.col(repeat_of) == F.col("_task"))).where(F.col(value).isNotNull() & F.col("_first").isNotNull())
    return met.groupBy(by).agg(F.count(F.lit(1)).alias("repeats"), F.expr(f"percentile(abs({value} - _first), 0.5)").alias("median_difference"))


def quotas(rows: DataFrame, by: str, rate: float, least: int, most: int) -> DataFrame:
    """``by, n, quota``: a share of each class, at least ``least``, at most ``most`` and what there is."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("quota", F.least(F.col("n"), F.lit(most), F.greatest(F.lit(least), F.ceil(F.col("n") * rate))))


def by_turns(rows: DataFrame, by: list[str], turn: str, order: Column, limit: int | str, key: str) -> DataFrame:
    """Draw from each group up to ``limit`` rows, one of each ``turn`` (a tile) after another: add ``place`` from 0.

    ``limit`` is a number or the name of a column. Rows are ranked in their turn at first, so only the first of each turn
    reach the second ranking, and a hot turn is cut early.
    """
    first = Window.partitionBy(*by, turn).orderBy(order, key)
    ranked = rows.withColumn("_round", F.row_number().over(first))
    bound = F.lit(limit) if isinstance(limit, int) else F.col(limit)
    ranked = ranked.where(F.col("_round") <= bound)
    second = Window.partitionBy(*by).orderBy("_round", F.md5(F.col(turn).cast("string")), turn)
    return ranked.withColumn("place", F.row_number().over(second) - 1).where(F.col("place") < bound).drop("_round")


def pending(tasks: DataFrame, measurements: DataFrame) -> DataFrame:
    """The queue of tasks still to do: not measured yet; a repeat only if the task it repeats was kept."""
    done = measurements.select("run_id", "task_id").distinct()
    kept = measurements.where("kept").select(F.col("run_id").alias("_run"), F.col("task_id").alias("_first")).distinct()
    open_ = tasks.join(done, ["run_id", "task_id"], "left_anti")
    repeat = F.coalesce(F.col("repeat_of_task_id"), F.lit("")) != ""
    plain = open_.where(~repeat)
    again = open_.where(repeat).join(kept, (F.col("run_id") == F.col("_run")) & (F.col("repeat_of_task_id") == F.col("_first")), "left_semi")
    return plain.unionByName(again)


def patch_window(anchor: str, extent: str, size: str) -> Column:
    """First pixel of a window of ``size`` around a relative anchor, moved into the image."""
    centre = F.bround(F.col(anchor) * (F.col(extent) - 1)).cast("int")
    return F.greatest(F.lit(0), F.least(centre - F.floor(F.col(size) / 2), F.col(extent) - F.col(size))).cast("int")


def with_fallback(attempts: DataFrame, key: str, order: str, passed: str, reason: str) -> DataFrame:
    """For each key its first attempt that passed, else its last; the reason of the first failure is kept.

    ``key, attempt, ok, fallback_used, replacement_reason``.
    """
    out = attempts.groupBy(key).agg(F.min(F.when(F.col(passed), F.col(order))).alias("_good"), F.max(order).alias("_last"), F.min(order).alias("_first"), F.min_by(reason, F.when(~F.col(passed), F.col(order))).alias("_reason"))
    chosen = F.coalesce("_good", "_last")
    return out.select(key, chosen.alias("attempt"), F.col("_good").isNotNull().alias("ok"), (chosen != F.col("_first")).alias("fallback_used"), F.when(chosen != F.col("_first"), F.col("_reason")).alias("replacement_reason"))


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """``struct(x0, y0, x1, y1)`` of what a rectangle ``(minx, miny, maxx, maxy)`` leaves of a segment (Liang-Barsky); null if nothing."""
    dx, dy = x1 - x0, y1 - y0
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, x0 - box[0]), (dx, box[2] - x0), (-dy, y0 - box[1]), (dy, box[3] - y0)):
        t = q / F.when(p != 0, p)
        enter, leave = F.greatest(enter, F.when(p < 0, t)), F.least(leave, F.when(p > 0, t))
        outside = outside | ((p == 0) & (q < 0))
    cut = F.struct((x0 + dx * enter).alias("x0"), (y0 + dy * enter).alias("y0"), (x0 + dx * leave).alias("x1"), (y0 + dy * leave).alias("y1"))
    return F.when(~outside & (enter <= leave), cut)
