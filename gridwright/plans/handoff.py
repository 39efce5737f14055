"""Queries on hand-off: what manifests and rows disagree on, what is missing or excluded, queues, anchors, completeness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import keys
from gridwright.operators import handoff, policy, width
from gridwright.plans.tiles import _OUT, _T, POLICY, _tiles
from gridwright.plans.widths import _measured, _tasks
from gridwright.session import table

ANCHOR_TEXTS = ("0.2,0.8; 0.5,0.5", " ;0.1 , 0.9;", "0.2", "1.2,0.1", "", "a,b")
PATCHES_PER_TILE = 3


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "selected_patches").withColumn("sheet", keys.tile_key(F.col("tile_shortname")))


def _excluded(spark: SparkSession, sf: str) -> DataFrame:
    tiles = _tiles(spark, sf)
    kept, _ = policy.apply_policy(tiles, POLICY, "tile_id")
    return tiles.join(kept.select("tile_id"), "tile_id", "left_anti").select(F.upper(F.trim("short_name")).alias("sheet"))


def excluded_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with patches though the policy, or the records' quality, excludes them."""
    unknown = table(spark, sf, "real_tiles_metadata").where("data_quality = 'unknown'").select(keys.tile_key(F.col("shortname")).alias("sheet"))
    return handoff.excluded_but_selected(_patches(spark, sf), [_excluded(spark, sf), unknown], "sheet")


def missing_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with patches for which no task says what is to be measured."""
    return handoff.missing_requirements(_patches(spark, sf), _tasks(spark, sf).select("sheet"), "sheet")


def fold_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets whose fold by their first patch, as a manifest has it, isn't that of all their patches."""
    rows = _patches(spark, sf).where("sheet is not null and split_fold is not null")
    told = rows.groupBy("sheet").agg(F.min_by("split_fold", "patch_key").alias("fold"), F.lit(1).cast("bigint").alias("folds"))
    found = rows.groupBy("sheet").agg(F.min("split_fold").alias("fold"), F.count_distinct("split_fold").alias("folds"))
    return handoff.disagreement(told, found, "sheet", ["fold", "folds"])


def count_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets for which patches and tasks don't name the same patches: numbers and digests differ."""
    told = handoff.list_digest(_patches(spark, sf), "sheet", "patch_id").where("sheet is not null")
    found = handoff.list_digest(_tasks(spark, sf), "sheet", "patch_id").where("sheet is not null")
    return handoff.disagreement(told, found, "sheet", ["items", "digest"]).select("sheet", "status", "items_told", "items_found")


def patch_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The list of patches that tasks name: entries, blank ones, different ones, and different ones in one spelling."""
    ids = table(spark, sf, "width_tasks").select("patch_id")
    plain = F.lower(F.trim("patch_id"))
    return ids.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.coalesce(plain, F.lit("")) == "").alias("blank"), F.count_distinct("patch_id").alias("different"), F.count_distinct(F.when(plain != "", plain)).alias("normalised")).withColumn("integral", F.col("different") == F.col("normalised"))


def _present(spark: SparkSession, sf: str) -> DataFrame:
    """Patches with the first of their two paths whose file the list of tiles has."""
    files = _tiles(spark, sf).select(keys.tile_key(F.col("image_path")).alias("file")).where("file is not null").distinct()
    rows = _patches(spark, sf).select("patch_key", "sheet", "quicklook_path", keys.tile_key(F.col("resolved_image_path")).alias("f1"), keys.tile_key(F.col("image_path")).alias("f2"))
    for k in ("f1", "f2"):
        rows = rows.join(files.select(F.col("file").alias(k), F.lit(True).alias(f"has_{k}")), k, "left")
    return rows.withColumn("found", F.when(F.col("has_f1"), F.col("f1")).when(F.col("has_f2"), F.col("f2")))


def data_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Patches by what is there of their data: the image by its resolved path or by its path, and a quick-look in PNG."""
    rows = _present(spark, sf)
    by = F.when(F.col("has_f1"), "resolved").when(F.col("has_f2"), "path").otherwise("missing")
    png = F.coalesce(F.lower("quicklook_path").endswith(".png"), F.lit(False))
    return rows.groupBy(by.alias("image"), png.alias("quicklook")).agg(F.count(F.lit(1)).alias("patches"))


def handoff_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of each kind and the exit code of the check."""
    rows = _present(spark, sf)
    excluded = excluded_selected(spark, sf)
    kinds = rows.where("sheet is null").select(F.lit("schema").alias("kind"))
    kinds = kinds.union(rows.join(excluded, "sheet", "left_semi").select(F.lit("policy"))).union(rows.where("found is null").select(F.lit("data")))
    return handoff.verdict(kinds)


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """What the list of tiles lacks of cities, sources of the image and bounds, and whether it may stand as it is."""
    df = _tiles(spark, sf)
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    bounds = sum((F.count_if(F.col(c).isNull()) for c in ("ul_x", "ul_y", "lr_x", "lr_y")), F.lit(0))
    out = df.agg(blank("city").alias("city_missing"), blank("image_path").alias("source_missing"), bounds.alias("bounds_missing"))
    return out.withColumn("complete", (F.col("city_missing") == 0) & (F.col("source_missing") == 0) & (F.col("bounds_missing") == 0))


def width_summary_metric(spark: SparkSession, sf: str) -> DataFrame:
    """Robust figures of first measurements by class in pixels and metres, with how far repeats are off and three flags."""
    rows = _measured(spark, sf).where("kept").withColumn("width_m_num", keys.decimal(F.col("width_m")))
    first = rows.where("coalesce(repeat_of_task_id, '') = ''")
    px = width.width_summary(first, "class_id", "width_px")
    m = width.width_summary(first.where("metric_valid"), "class_id", "width_m_num").select("class_id", *[F.round(c, 6).alias(f"{c}_m") for c in ("median", "iqr", "mad")])
    again = lambda v, of: width.repeat_differences(of, "run_id", "task_id", "repeat_of_task_id", v, "class_id")
    off = again("width_px", rows).select("class_id", F.round("median_difference", 6).alias("repeat_px"))
    off_m = again("width_m_num", rows.where("metric_valid")).select("class_id", F.round("median_difference", 6).alias("repeat_m"))
    out = px.join(m, "class_id", "left").join(off, "class_id", "left").join(off_m, "class_id", "left")
    return out.select("class_id", "n", *[F.round(c, 6).alias(f"{c}_px") for c in ("median", "iqr", "mad")], "median_m", "iqr_m", "mad_m", "repeat_px", "repeat_m", "few", "spread", F.coalesce(F.col("repeat_px") > 1.0, F.lit(False)).alias("unreliable"), "final_width_px")


def task_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's queue of open tasks: that of the least task_key first, those of unknown class last."""
    tasks = _tasks(spark, sf).where("run_id is not null")
    open_ = width.pending(tasks, _measured(spark, sf))
    first = open_.groupBy("run_id").agg(F.min("task_key").alias("_first"))
    out = handoff.queue(open_.join(first, "run_id"), "run_id", "task_key", F.col("class_id").isNull(), F.col("task_key") == F.col("_first"))
    return out.select("run_id", "task_key", "place")


def undone(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements of each run that are left when its last is undone."""
    left = handoff.undo_last(_measured(spark, sf).where("run_id is not null"), "run_id", "measure_id")
    return left.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("measure_id").alias("last_id"))


def anchor_texts(spark: SparkSession, sf: str) -> DataFrame:
    """How typed anchors are read."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ANCHOR_TEXTS)], "id int, text string")
    return rows.select("id", handoff.parse_anchors(F.col("text")).alias("a")).select("id", F.size("a").alias("anchors"), F.col("a")[0]["x"].alias("x"), F.col("a")[0]["y"].alias("y")).where("anchors >= 0")


def anchor_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of the default anchors on each patch's tile image, for tiles no smaller than a patch."""
    anchors = spark.createDataFrame([(k, *a) for k, a in enumerate(handoff.default_anchors(PATCHES_PER_TILE), 1)], "anchor int, ax double, ay double")
    tiles = table(spark, sf, "selected_patches").where("tile_width_px >= patch_size_px and tile_height_px >= patch_size_px").select("patch_key", "patch_size_px", "tile_width_px", "tile_height_px")
    both = tiles.crossJoin(F.broadcast(anchors))  # three rows
    return both.select("patch_key", "anchor", width.patch_window("ax", "tile_width_px", "patch_size_px").alias("x0"), width.patch_window("ay", "tile_height_px", "patch_size_px").alias("y0"))


def validation_block(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, runs with a selection, and how their recorded sizes agree with it."""
    runs = table(spark, sf, "min_distance_runs")
    size = F.coalesce(F.size("selected_tile_ids"), F.lit(0))
    return runs.agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(size > 0).alias("with_selection"), F.count_if(size == F.col("n_selected")).alias("size_agrees"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (excluded_selected, missing_masks, fold_differences, count_agreement, patch_filter, data_presence, handoff_verdict, completeness, width_summary_metric, task_queue, undone, anchor_texts, anchor_plan, validation_block)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    sheet, key = keys.tile_key_sql("tile_shortname"), keys.tile_key_sql
    last = lambda t, k: f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ingested_at DESC, recorded_at DESC) AS rn FROM {t} WHERE {k} IS NOT NULL) WHERE rn = 1)"
    patches, tasks, measured = f"(SELECT *, {sheet} AS sheet FROM selected_patches)", f"(SELECT *, {sheet} AS sheet FROM {last('width_tasks', 'task_key')})", last("width_measurements", "measure_id")
    out = f"SELECT upper(trim(short_name)) AS sheet FROM {_T} WHERE {_OUT} UNION SELECT {key('shortname')} FROM real_tiles_metadata WHERE data_quality = 'unknown'"
    present = f"""f AS (SELECT DISTINCT {key('image_path')} AS file FROM new_all_tiles WHERE {key('image_path')} IS NOT NULL),
        r AS (SELECT patch_key, sheet, quicklook_path, {key('resolved_image_path')} IN (SELECT file FROM f) AS a, {key('image_path')} IN (SELECT file FROM f) AS b FROM {patches})"""
    kept = f"(SELECT *, TRY_CAST(replace(trim(width_m), ',', '.') AS DOUBLE) AS wm FROM {measured} WHERE kept)"
    robust = lambda v, where: f"""(WITH k AS (SELECT class_id, {v} AS v FROM {kept} WHERE coalesce(repeat_of_task_id, '') = '' AND class_id IS NOT NULL AND {v} IS NOT NULL AND {where}), o AS (SELECT class_id, count(*) AS n, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM k GROUP BY 1)
        SELECT class_id, any_value(n) AS n, any_value(med) AS med, any_value(iqr) AS iqr, quantile_cont(abs(v - med), 0.5) AS mad FROM k JOIN o USING (class_id) GROUP BY 1)"""  # noqa: E731
    again = lambda v, where: f"(SELECT b.class_id, quantile_cont(abs(b.{v} - a.{v}), 0.5) AS d FROM {kept} b JOIN {kept} a ON a.run_id = b.run_id AND a.task_id = b.repeat_of_task_id WHERE b.repeat_of_task_id <> '' AND a.{v} IS NOT NULL AND b.{v} IS NOT NULL AND {where} GROUP BY 1)"
    anchors = ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for k, (x, y) in enumerate(handoff.default_anchors(PATCHES_PER_TILE), 1))
    window = lambda a, e: f"CAST(greatest(0, least(round_even({a} * ({e} - 1), 0) - patch_size_px // 2, {e} - patch_size_px)) AS INTEGER)"
    return {
        "excluded_selected": f"SELECT DISTINCT sheet FROM {patches} WHERE sheet IN ({out})",
        "missing_masks": f"SELECT DISTINCT sheet FROM {patches} WHERE sheet IS NOT NULL AND sheet NOT IN (SELECT sheet FROM {tasks} WHERE sheet IS NOT NULL)",
        "fold_differences": f"""WITH s AS (SELECT sheet, arg_min(split_fold, patch_key) AS fold_told, min(split_fold) AS fold_found, count(DISTINCT split_fold) AS folds_found FROM {patches} WHERE sheet IS NOT NULL AND split_fold IS NOT NULL GROUP BY 1)
            SELECT sheet, 'different' AS status, fold_told, fold_found, 1::BIGINT AS folds_told, folds_found FROM s WHERE fold_told <> fold_found OR folds_found <> 1""",
        "count_agreement": f"""WITH a AS (SELECT sheet, count(DISTINCT patch_id) AS n, string_agg(DISTINCT patch_id, '|' ORDER BY patch_id) AS d FROM {patches} WHERE sheet IS NOT NULL AND patch_id IS NOT NULL GROUP BY 1), b AS (SELECT sheet, count(DISTINCT patch_id) AS n, string_agg(DISTINCT patch_id, '|' ORDER BY patch_id) AS d FROM {tasks} WHERE sheet IS NOT NULL AND patch_id IS NOT NULL GROUP BY 1)
            SELECT sheet, CASE WHEN b.n IS NULL THEN 'only_told' WHEN a.n IS NULL THEN 'only_found' ELSE 'different' END AS status, a.n AS items_told, b.n AS items_found FROM a FULL JOIN b USING (sheet) WHERE a.d IS DISTINCT FROM b.d""",
        "patch_filter": "SELECT count(*) AS entries, count(*) FILTER (WHERE coalesce(trim(patch_id), '') = '') AS blank, count(DISTINCT patch_id) AS different, count(DISTINCT nullif(lower(trim(patch_id)), '')) AS normalised, count(DISTINCT patch_id) = count(DISTINCT nullif(lower(trim(patch_id)), '')) AS integral FROM width_tasks",
        "data_presence": f"WITH {present} SELECT CASE WHEN a THEN 'resolved' WHEN b THEN 'path' ELSE 'missing' END AS image, coalesce(lower(quicklook_path) LIKE '%.png', false) AS quicklook, count(*) AS patches FROM r GROUP BY 1, 2",
        "handoff_verdict": f"""WITH {present}, c AS (SELECT count(*) FILTER (WHERE sheet IS NULL) AS schema_violations, count(*) FILTER (WHERE sheet IN ({out})) AS policy_violations, count(*) FILTER (WHERE NOT coalesce(a, false) AND NOT coalesce(b, false)) AS data_violations FROM r)
            SELECT *, CASE WHEN schema_violations > 0 THEN 2 WHEN policy_violations > 0 THEN 4 WHEN data_violations > 0 THEN 3 ELSE 0 END AS exit_code FROM c""",
        "completeness": "WITH c AS (SELECT count(*) FILTER (WHERE coalesce(trim(city), '') = '') AS city_missing, count(*) FILTER (WHERE coalesce(trim(image_path), '') = '') AS source_missing, count(*) FILTER (WHERE ul_x IS NULL) + count(*) FILTER (WHERE ul_y IS NULL) + count(*) FILTER (WHERE lr_x IS NULL) + count(*) FILTER (WHERE lr_y IS NULL) AS bounds_missing FROM new_all_tiles) SELECT *, city_missing = 0 AND source_missing = 0 AND bounds_missing = 0 AS complete FROM c",
        "width_summary_metric": f"""SELECT p.class_id, p.n, round(p.med, 6) AS median_px, round(p.iqr, 6) AS iqr_px, round(p.mad, 6) AS mad_px, round(m.med, 6) AS median_m, round(m.iqr, 6) AS iqr_m, round(m.mad, 6) AS mad_m, round(a.d, 6) AS repeat_px, round(b.d, 6) AS repeat_m, p.n < 5 AS few, p.iqr > 2 AS spread, coalesce(a.d > 1.0, false) AS unreliable, CAST(round_even(p.med, 0) AS INTEGER) AS final_width_px
            FROM {robust('width_px', 'true')} p LEFT JOIN {robust('wm', 'metric_valid')} m USING (class_id) LEFT JOIN {again('width_px', 'true')} a USING (class_id) LEFT JOIN {again('wm', 'a.metric_valid AND b.metric_valid')} b USING (class_id)""",
        "task_queue": f"""WITH t AS (SELECT * FROM {tasks} WHERE run_id IS NOT NULL), m AS (SELECT * FROM {measured}), o AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.run_id = t.run_id AND m.task_id = t.task_id) AND (coalesce(repeat_of_task_id, '') = '' OR EXISTS (SELECT 1 FROM m WHERE m.run_id = t.run_id AND m.task_id = t.repeat_of_task_id AND m.kept))),
            f AS (SELECT *, min(task_key) OVER (PARTITION BY run_id) AS first_key FROM o) SELECT run_id, task_key, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN task_key = first_key THEN 0 WHEN class_id IS NULL THEN 2 ELSE 1 END, task_key) - 1 AS INTEGER) AS place FROM f""",
        "undone": f"WITH m AS (SELECT run_id, measure_id, max(measure_id) OVER (PARTITION BY run_id) AS top FROM {measured} WHERE run_id IS NOT NULL) SELECT run_id, count(*) AS n, max(measure_id) AS last_id FROM m WHERE measure_id < top GROUP BY 1",
        "anchor_texts": "SELECT * FROM (VALUES (0, 2, 0.2::DOUBLE, 0.8::DOUBLE), (1, 1, 0.1::DOUBLE, 0.9::DOUBLE)) t(id, anchors, x, y)",
        "anchor_plan": f"WITH a(anchor, ax, ay) AS (VALUES {anchors}) SELECT patch_key, anchor, {window('ax', 'tile_width_px')} AS x0, {window('ay', 'tile_height_px')} AS y0 FROM selected_patches, a WHERE tile_width_px >= patch_size_px AND tile_height_px >= patch_size_px",
        "validation_block": "SELECT count(*) AS deliveries, count(*) FILTER (WHERE len(selected_tile_ids) > 0) AS with_selection, count(*) FILTER (WHERE coalesce(len(selected_tile_ids), 0) = n_selected) AS size_agrees FROM min_distance_runs",
    }
