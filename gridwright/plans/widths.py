"""Queries on patches, tasks and measurements of line widths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import keys
from gridwright.operators import width
from gridwright.operators.rank import latest
from gridwright.session import table


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "width_tasks"), "task_key", ["ingested_at", "recorded_at"]).withColumn("sheet", keys.tile_key(F.col("tile_shortname")))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "width_measurements"), "measure_id", ["ingested_at", "recorded_at"])


def width_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Robust figures of the kept widths of each class."""
    out = width.width_summary(_measured(spark, sf).where("kept"), "class_id", "width_px")
    return out.select("class_id", "n", *[F.round(c, 6).alias(c) for c in ("median", "iqr", "mad")], "final_width_px", "few", "spread")


def repeat_differences(spark: SparkSession, sf: str) -> DataFrame:
    """How far repeated measurements are from the first ones, by class."""
    out = width.repeat_differences(_measured(spark, sf).where("kept"), "run_id", "task_id", "repeat_of_task_id", "width_px", "class_id")
    return out.select("class_id", "repeats", F.round("median_difference", 6).alias("median_difference"))


def quota_targets(spark: SparkSession, sf: str) -> DataFrame:
    """How many tasks each class gives: two per cent, 5 to 40."""
    return width.quotas(_tasks(spark, sf), "class_id", 0.02, 5, 40).select("class_id", "n", F.col("quota").cast("long").alias("quota"))


def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """The tasks drawn to the quota of each class, sheet after sheet."""
    tasks = _tasks(spark, sf).where("sheet is not null")
    wanted = quota_targets(spark, sf).select("class_id", "quota")
    out = width.by_turns(tasks.join(F.broadcast(wanted), "class_id"), ["class_id"], "sheet", F.md5(F.col("task_key").cast("string")), "quota", "task_key")  # one row a class
    return out.select("class_id", "task_key", "sheet", F.format_string("task_%05d", "place").alias("task_name"))


def repeat_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Three primary tasks of each class to be done again."""
    primary = _tasks(spark, sf).where((F.lower(F.trim("pass_type")) == "primary") & F.col("class_id").isNotNull())
    return width.by_turns(primary.withColumn("one", F.lit(1)), ["class_id"], "one", F.md5(F.concat(F.lit("again"), F.col("task_key").cast("string"))), 3, "task_key").select("class_id", "task_key", F.col("place").cast("long").alias("place"))


def pending_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks still to be measured, by run."""
    open_ = width.pending(_tasks(spark, sf), _measured(spark, sf))
    return open_.groupBy("run_id").agg(F.count(F.lit(1)).alias("open_tasks"), F.min("queue_position").alias("next_position"))


def task_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks, measured and kept ones of each run."""
    tasks = _tasks(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("tasks"))
    done = _measured(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("measured"), F.count_if("kept").alias("kept"))
    return tasks.join(done, "run_id", "left")


def patch_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The window of each patch worked out again from its anchor."""
    df = table(spark, sf, "selected_patches")
    x, y = width.patch_window("selected_anchor_x", "tile_width_px", "patch_size_px"), width.patch_window("selected_anchor_y", "tile_height_px", "patch_size_px")
    return df.select("patch_key", x.alias("x0_again"), y.alias("y0_again"), ((x == F.col("x0")) & (y == F.col("y0"))).alias("agrees"))


def patch_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """For each sheet the first patch that passed its check, else the last tried."""
    df = table(spark, sf, "selected_patches").withColumn("sheet", keys.tile_key(F.col("tile_shortname"))).where("sheet is not null")
    attempts = df.groupBy("sheet", "patch_index").agg(F.max(F.col("qc_status") == "qc_passed").alias("passed"), F.min("qc_reason").alias("qc_reason"))
    return width.with_fallback(attempts, "sheet", "patch_index", "passed", "qc_reason")


def pixel_distances(spark: SparkSession, sf: str) -> DataFrame:
    """The distance of the clicks of each measurement on the ground, in metres to six digits."""
    dx, dy = F.col("click1_x_px") - F.col("click2_x_px"), F.col("click1_y_px") - F.col("click2_y_px")
    return _measured(spark, sf).select("measure_id", F.bround(F.hypot(dx * F.col("pixel_size_x_m"), dy * F.col("pixel_size_y_m")), 4).alias("ground_m"))


def clipped_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the line between two clicks that is in the window of 64 pixels around the anchor."""
    ax, ay = F.col("anchor_x_px").cast("double"), F.col("anchor_y_px").cast("double")
    box = (ax - 1.0, ay - 1.0, ax + 1.0, ay + 1.0)
    cut = width.clip_segment(F.col("click1_x_px"), F.col("click1_y_px"), F.col("click2_x_px"), F.col("click2_y_px"), box)
    return _measured(spark, sf).select("measure_id", cut.alias("c")).where("c is not null").select("measure_id", F.round(F.hypot(F.col("c.x1") - F.col("c.x0"), F.col("c.y1") - F.col("c.y0")), 4).alias("length_px"))


def fold_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements by the fold of their patch."""
    folds = table(spark, sf, "selected_patches").groupBy("patch_id").agg(F.min("split_fold").alias("fold"))
    return _measured(spark, sf).join(folds, "patch_id", "left").groupBy("fold").agg(F.count(F.lit(1)).alias("measurements"), F.count_if("kept").alias("kept"))


def audit_subset(spark: SparkSession, sf: str) -> DataFrame:
    """One patch of each rare class and two of the common ones."""
    tasks = _tasks(spark, sf).where("class_id is not null and patch_id is not null")
    counts = tasks.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min("patch_id").alias("_first"))
    rare = counts.where("n < 200").select("class_id", F.col("_first").alias("patch_id"))
    common = tasks.join(counts.where("n >= 200").select("class_id"), "class_id", "left_semi").join(rare.select("patch_id"), "patch_id", "left_anti").select("patch_id").distinct().orderBy("patch_id").limit(2)
    return rare.unionByName(common.withColumn("class_id", F.lit(None).cast("int")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (width_summary, repeat_differences, quota_targets, round_robin, repeat_tasks, pending_tasks, task_progress, patch_windows, patch_fallback, pixel_distances, clipped_clicks, fold_mapping, audit_subset)
    return {f.__name__: f for f in named}


_TASKS = f"(SELECT * EXCLUDE (k), {keys.tile_key_sql('tile_shortname')} AS sheet FROM (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY ingested_at DESC, recorded_at DESC) AS k FROM width_tasks) WHERE k = 1 AND task_key IS NOT NULL)"
_MEASURED = "(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY measure_id ORDER BY ingested_at DESC, recorded_at DESC) AS k FROM width_measurements) WHERE k = 1 AND measure_id IS NOT NULL)"
_QUOTAS = f"SELECT class_id, count(*) AS n, CAST(least(count(*), 40, greatest(5, ceil(count(*) * 0.02))) AS BIGINT) AS quota FROM {_TASKS} WHERE class_id IS NOT NULL GROUP BY class_id"


def _window_sql(anchor: str, extent: str) -> str:
    return f"CAST(greatest(0, least(CAST(round_even({anchor} * ({extent} - 1), 0) AS INT) - patch_size_px // 2, {extent} - patch_size_px)) AS INTEGER)"


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    x, y = _window_sql("selected_anchor_x", "tile_width_px"), _window_sql("selected_anchor_y", "tile_height_px")
    edges = [("-dx", "click1_x_px - (anchor_x_px - 1.0)"), ("dx", "(anchor_x_px + 1.0) - click1_x_px"), ("-dy", "click1_y_px - (anchor_y_px - 1.0)"), ("dy", "(anchor_y_px + 1.0) - click1_y_px")]
    enter = ", ".join(f"CASE WHEN {p} < 0 THEN ({q}) / ({p}) END" for p, q in edges)
    leave = ", ".join(f"CASE WHEN {p} > 0 THEN ({q}) / ({p}) END" for p, q in edges)
    outside = " OR ".join(f"(({p}) = 0 AND ({q}) < 0)" for p, q in edges)
    return {
        "width_summary": f"""WITH m AS (SELECT class_id, width_px FROM {_MEASURED} WHERE kept AND class_id IS NOT NULL AND width_px IS NOT NULL), o AS (SELECT class_id, count(*) AS n, quantile_cont(width_px, 0.5) AS median, quantile_cont(width_px, 0.75) - quantile_cont(width_px, 0.25) AS iqr FROM m GROUP BY 1),
            d AS (SELECT class_id, quantile_cont(abs(width_px - median), 0.5) AS mad FROM m JOIN o USING (class_id) GROUP BY 1) SELECT class_id, n, round(median, 6) AS median, round(iqr, 6) AS iqr, round(mad, 6) AS mad, CAST(round_even(median, 0) AS INTEGER) AS final_width_px, n < 5 AS few, iqr > 2 AS spread FROM o JOIN d USING (class_id)""",
        "repeat_differences": f"""WITH m AS (SELECT * FROM {_MEASURED} WHERE kept) SELECT r.class_id, count(*) AS repeats, round(quantile_cont(abs(r.width_px - f.width_px), 0.5), 6) AS median_difference FROM m r JOIN m f ON r.run_id = f.run_id AND r.repeat_of_task_id = f.task_id
            WHERE r.repeat_of_task_id <> '' AND r.width_px IS NOT NULL AND f.width_px IS NOT NULL GROUP BY 1""",
        "quota_targets": _QUOTAS,
        "round_robin": f"""WITH q AS ({_QUOTAS}), a AS (SELECT t.*, quota, row_number() OVER (PARTITION BY class_id, sheet ORDER BY md5(CAST(task_key AS VARCHAR)), task_key) AS r FROM {_TASKS} t JOIN q USING (class_id) WHERE sheet IS NOT NULL),
            b AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY r, md5(sheet), sheet) - 1 AS place FROM a) SELECT class_id, task_key, sheet, format('task_{{:05d}}', place) AS task_name FROM b WHERE place < quota""",
        "repeat_tasks": f"SELECT class_id, task_key, place FROM (SELECT class_id, task_key, row_number() OVER (PARTITION BY class_id ORDER BY md5('again' || CAST(task_key AS VARCHAR)), task_key) - 1 AS place FROM {_TASKS} WHERE lower(trim(pass_type)) = 'primary' AND class_id IS NOT NULL) WHERE place < 3",
        "pending_tasks": f"""WITH m AS {_MEASURED} SELECT run_id, count(*) AS open_tasks, min(queue_position) AS next_position FROM {_TASKS} t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run_id = t.run_id AND m.task_id = t.task_id)
            AND (coalesce(repeat_of_task_id, '') = '' OR EXISTS (SELECT 1 FROM m WHERE m.kept AND m.run_id = t.run_id AND m.task_id = t.repeat_of_task_id)) GROUP BY run_id""",
        "task_progress": f"WITH t AS (SELECT run_id, count(*) AS tasks FROM {_TASKS} GROUP BY 1), m AS (SELECT run_id, count(*) AS measured, count(*) FILTER (WHERE kept) AS kept FROM {_MEASURED} GROUP BY 1) SELECT * FROM t LEFT JOIN m USING (run_id)",
        "patch_windows": f"SELECT patch_key, {x} AS x0_again, {y} AS y0_again, {x} = x0 AND {y} = y0 AS agrees FROM selected_patches",
        "patch_fallback": f"""WITH a AS (SELECT {keys.tile_key_sql('tile_shortname')} AS sheet, patch_index, max(qc_status = 'qc_passed') AS passed, min(qc_reason) AS qc_reason FROM selected_patches GROUP BY 1, 2 HAVING sheet IS NOT NULL),
            g AS (SELECT sheet, min(patch_index) FILTER (WHERE passed) AS good, max(patch_index) AS last, min(patch_index) AS first, arg_min(qc_reason, patch_index) FILTER (WHERE NOT passed) AS reason FROM a GROUP BY 1)
            SELECT sheet, coalesce(good, last) AS attempt, good IS NOT NULL AS ok, coalesce(good, last) <> first AS fallback_used, CASE WHEN coalesce(good, last) <> first THEN reason END AS replacement_reason FROM g""",
        "pixel_distances": f"SELECT measure_id, round_even(sqrt(pow((click1_x_px - click2_x_px) * pixel_size_x_m, 2) + pow((click1_y_px - click2_y_px) * pixel_size_y_m, 2)), 4) AS ground_m FROM {_MEASURED}",
        "clipped_clicks": f"""WITH m AS (SELECT *, click2_x_px - click1_x_px AS dx, click2_y_px - click1_y_px AS dy FROM {_MEASURED}), c AS (SELECT measure_id, dx, dy, greatest(0.0, {enter}) AS e, least(1.0, {leave}) AS l, {outside} AS out FROM m)
            SELECT measure_id, round(sqrt(pow(dx * (l - e), 2) + pow(dy * (l - e), 2)), 4) AS length_px FROM c WHERE NOT out AND e <= l""",
        "fold_mapping": f"WITH f AS (SELECT patch_id, min(split_fold) AS fold FROM selected_patches GROUP BY 1) SELECT fold, count(*) AS measurements, count(*) FILTER (WHERE kept) AS kept FROM {_MEASURED} LEFT JOIN f USING (patch_id) GROUP BY fold",
        "audit_subset": f"""WITH t AS (SELECT class_id, patch_id FROM {_TASKS} WHERE class_id IS NOT NULL AND patch_id IS NOT NULL), c AS (SELECT class_id, count(*) AS n, min(patch_id) AS first FROM t GROUP BY 1), r AS (SELECT class_id, first AS patch_id FROM c WHERE n < 200)
            SELECT * FROM r UNION ALL (SELECT CAST(NULL AS INTEGER), patch_id FROM (SELECT DISTINCT patch_id FROM t WHERE class_id IN (SELECT class_id FROM c WHERE n >= 200) AND patch_id NOT IN (SELECT patch_id FROM r) ORDER BY patch_id LIMIT 2))""",
    }
