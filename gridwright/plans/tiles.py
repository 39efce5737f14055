"""Queries on sheet metadata: cleaning, projection, policy, enrichment, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import geo, keys
from gridwright.operators import enrich, policy
from gridwright.session import table

POLICY = {
    "constants": {"war": {"first": 1914, "last": 1918}},
    "rules": [
        {"id": "late", "action": "exclude_from_candidate_pool", "match": {"year_gt": 1940}},
        {"id": "heath", "action": "exclude_from_candidate_pool", "match": {"long_name_contains": ["Heide", "moor"], "year_lt": 1900}},
        {"id": "named", "action": "exclude_from_candidate_pool", "match": {"short_name": ["kdr_001", "KDR_002A"]}},
        {"id": "war", "action": "flag_for_reporting", "rationale": "war years", "match": {"year_gte_ref": "war.first", "year_lte_ref": "war.last"}},
        {"id": "market", "action": "flag_for_reporting", "rationale": "market town", "match": {"long_name_contains": r"\(Markt\)"}},
        {"id": "nowhere", "action": "flag_for_reporting", "rationale": "unknown constant", "match": {"year_lt_ref": "war.none"}},
    ],
}
#: Names looked for in the pool, each in several columns.
TERMS = ["KDR_010", "thal", "Lodrowmoor", "kdr_123a"]


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "new_all_tiles")
    return df.select("tile_id", F.col("shortname").alias("short_name"), F.col("longname").alias("long_name"), "city", "year", "lon", "lat", "quadrant", "ul_x", "ul_y", "lr_x", "lr_y", "image_path")


def metadata_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Records with stand-ins for missing values as nulls, one spelling of the sheet, and centres."""
    df = table(spark, sf, "real_tiles_metadata")
    c = {n: keys.number(F.col(n)) for n in ("ul_x", "ul_y", "lr_x", "lr_y", "year")}
    return df.select("record_id", keys.tile_key(F.col("shortname")).alias("sheet"), keys.clean(F.col("city")).alias("city"), F.when(c["year"] != 0, c["year"]).cast("int").alias("year"),
                     keys.clean(F.col("source_crs")).alias("source_crs"), ((c["ul_x"] + c["lr_x"]) / 2).alias("center_x"), ((c["ul_y"] + c["lr_y"]) / 2).alias("center_y"), keys.boolish(F.col("crs_explicit")).alias("crs_explicit"))


def year_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The year of a record, else the first four digits in a row of its long name."""
    year = keys.number(F.col("year"))
    return table(spark, sf, "real_tiles_metadata").select("record_id", F.coalesce(F.when(year != 0, year).cast("int"), F.regexp_extract("longname", r"([0-9]{4})", 1).try_cast("int")).alias("year"))


def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets of each year with the extent of their positions."""
    df = _tiles(spark, sf).where(geo.is_position(F.col("lon"), F.col("lat")))
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("tiles"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.count_distinct("city").alias("cities"))


def reprojected(spark: SparkSession, sf: str) -> DataFrame:
    """Centres in transverse Mercator metres, to the centimetre."""
    df = _tiles(spark, sf).where(geo.is_position(F.col("lon"), F.col("lat")))
    x, y = geo.lonlat_to_utm(F.col("lon"), F.col("lat"))
    return df.select("tile_id", F.round(x, 2).alias("proj_x"), F.round(y, 2).alias("proj_y"))


def metric_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """The box around a sheet's four corners in transverse Mercator metres."""
    df = _tiles(spark, sf).where("ul_x is not null and ul_y is not null and lr_x is not null and lr_y is not null")
    corners = [geo.lonlat_to_utm(*geo.mercator_to_lonlat(F.col(x), F.col(y))) for x in ("ul_x", "lr_x") for y in ("ul_y", "lr_y")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return df.select("tile_id", *[F.round(v, 2).alias(n) for n, v in (("minx_m", F.least(*xs)), ("maxx_m", F.greatest(*xs)), ("miny_m", F.least(*ys)), ("maxy_m", F.greatest(*ys)))])


def policy_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets that no excluding rule takes out."""
    kept, _ = policy.apply_policy(_tiles(spark, sf), POLICY, "tile_id")
    return kept.select("tile_id", "short_name", "year")


def policy_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets among them that a reporting rule names."""
    return policy.apply_policy(_tiles(spark, sf), POLICY, "tile_id")[1]


def anchor_match(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets that a term names by long name, short name or city, with the first such term."""
    hit = F.lit(None).cast("int")
    for k, term in reversed(list(enumerate(TERMS))):
        low = term.lower()
        here = F.lower("long_name").contains(low) | (F.lower("short_name") == low) | (F.lower("city") == low)
        hit = F.when(F.coalesce(here, F.lit(False)), k).otherwise(hit)
    return _tiles(spark, sf).select("tile_id", hit.alias("term")).where("term is not null")


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "real_tiles_metadata")
    return df.select("record_id", keys.tile_key(F.col("shortname")).alias("sheet"), keys.clean(F.col("city")).alias("city"))


def enrich_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a city take that of their sheet in the list of tiles."""
    source = _tiles(spark, sf).select(F.col("short_name").alias("sheet"), keys.clean(F.col("city")).alias("city"))
    return enrich.fill_from(_sheets(spark, sf), source, "sheet", ["city"], [F.col("city").asc_nulls_last()])


def enrich_variant(spark: SparkSession, sf: str) -> DataFrame:
    """The same, falling back on the sheet without variant letters or another variant."""
    source = _tiles(spark, sf).select(F.col("short_name").alias("sheet"), keys.clean(F.col("city")).alias("city"))
    return enrich.fill_from_variant(_sheets(spark, sf), source, "sheet", ["city"])


def override_city(spark: SparkSession, sf: str) -> DataFrame:
    """A city from the trusted source replaces that of the list."""
    fixes = table(spark, sf, "real_tiles_metadata").where("source = 'city_overrides'").select(keys.tile_key(F.col("shortname")).alias("short_name"), keys.clean(F.col("city")).alias("city"))
    return enrich.override(_tiles(spark, sf).select("tile_id", "short_name", "city"), fixes, "short_name", "city")


def crs_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Records by where their reference system comes from, and whether they would pass a strict check."""
    df = table(spark, sf, "real_tiles_metadata")
    known = keys.clean(F.col("source_crs")).isNotNull()
    status = F.when(known & F.col("crs_explicit"), "explicit").when(known & keys.clean(F.col("crs_source")).isNotNull(), "derived").when(known, "assumed").otherwise("missing")
    rows = df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("data_quality") == "ok").alias("ok_records"))
    return rows.withColumn("strict_ready", F.col("status").isin("explicit", "derived"))


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with more than one record, and how many positions these have."""
    rows = table(spark, sf, "real_tiles_metadata").select(keys.tile_key(F.col("shortname")).alias("sheet"), "ul_x", "ul_y")
    return rows.where("sheet is not null").groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ul_x", "ul_y").alias("positions")).where("n > 1")


def year_scope_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and years before and after the policy."""
    before = _tiles(spark, sf)
    after, _ = policy.apply_policy(before, POLICY, "tile_id")
    figures = [F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.col("year").isNull()).alias("without_year")]
    return before.agg(F.lit("before").alias("scope"), *figures).unionByName(after.agg(F.lit("after").alias("scope"), *figures))


def align_audit(spark: SparkSession, sf: str) -> DataFrame:
    """How far the records' corners are from those of the list, by source."""
    tiles = _tiles(spark, sf).select(F.col("short_name").alias("sheet"), F.col("ul_x").alias("x0"), F.col("ul_y").alias("y0"))
    rows = table(spark, sf, "real_tiles_metadata").select("source", keys.tile_key(F.col("shortname")).alias("sheet"), keys.number(F.col("ul_x")).alias("x"), keys.number(F.col("ul_y")).alias("y"))
    met = rows.join(tiles, "sheet", "left").withColumn("offset", F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")))
    return met.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(F.col("x0").isNull()).alias("unmatched"), F.count_if(F.col("offset") > 1000).alias("outliers"), F.round(F.expr("percentile(offset, 0.5)"), 3).alias("median_offset"))


def handoff_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that patches break."""
    df = table(spark, sf, "selected_patches")
    return enrich.violations(df, "patch_key", {
        "tile_empty": keys.clean(F.col("tile_shortname")).isNull(), "path_empty": keys.clean(F.col("image_path")).isNull(), "bounds": (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")),
        "fold_without_pass": F.col("split_fold").isNotNull() & (F.col("qc_status") != "qc_passed"), "fold_range": ~F.col("split_fold").between(1, 5), "beyond_image": (F.col("x1") > F.col("tile_width_px")) | (F.col("y1") > F.col("tile_height_px")),
    })


def tile_in_two_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets whose patches are in more than one fold."""
    df = table(spark, sf, "selected_patches").select(keys.tile_key(F.col("tile_shortname")).alias("sheet"), "split_fold")
    return df.where("sheet is not null").groupBy("sheet").agg(F.count_distinct("split_fold").alias("folds")).where("folds > 1")


def fold_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Patches and sheets of each fold."""
    df = table(spark, sf, "selected_patches").where("qc_status = 'qc_passed'")
    return df.groupBy("split_fold").agg(F.count(F.lit(1)).alias("patches"), F.count_distinct(keys.tile_key(F.col("tile_shortname"))).alias("sheets"))


def tree_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Image files of the list against those of the records, by size of the sheet's name as content."""
    a = _tiles(spark, sf).where("image_path is not null").groupBy(keys.tile_key(F.col("image_path")).alias("path")).agg(F.sha2(F.min("city"), 256).alias("digest"))
    b = table(spark, sf, "real_tiles_metadata").groupBy(keys.tile_key(F.col("image_path")).alias("path")).agg(F.sha2(F.min("city"), 256).alias("digest")).where("path is not null")
    return enrich.compare_trees(a.where("path is not null"), b, "path", "digest")


def allow_list(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets wanted by patches: whether the list has them."""
    wanted = table(spark, sf, "selected_patches").select(keys.tile_key(F.col("tile_shortname")).alias("short_name")).where("short_name is not null").distinct()
    there = _tiles(spark, sf).select("short_name").distinct()
    return wanted.join(there, "short_name", "left_semi").withColumn("found", F.lit(True)).unionByName(wanted.join(there, "short_name", "left_anti").withColumn("found", F.lit(False)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (metadata_cleaned, year_extraction, dataset_summary, reprojected, metric_rectangles, policy_exclude, policy_flags, anchor_match, enrich_exact, enrich_variant, override_city, crs_audit, duplicates, year_scope_audit, align_audit, handoff_checks, tile_in_two_folds, fold_counts, tree_compare, allow_list)
    return {f.__name__: f for f in named}


_T = "(SELECT tile_id, shortname AS short_name, longname AS long_name, city, year, lon, lat, ul_x, ul_y, lr_x, lr_y, image_path FROM new_all_tiles)"
_PLACED = f"(SELECT * FROM {_T} WHERE NOT isnan(lon) AND NOT isnan(lat) AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0))"
_KEY = keys.tile_key_sql("shortname")
_OUT = "(coalesce(year > 1940, false) OR (coalesce(regexp_matches(long_name, '(?i)Heide') OR regexp_matches(long_name, '(?i)moor'), false) AND coalesce(year < 1900, false)) OR coalesce(lower(trim(short_name)) IN ('kdr_001', 'kdr_002a'), false))"
_SHEETS = f"(SELECT record_id, {_KEY} AS sheet, {keys.clean_sql('city')} AS city FROM real_tiles_metadata)"


def _num(c: str) -> str:
    return f"(CASE WHEN NOT isnan({c}) THEN {c} END)"


def _utm_sql(lon: str, lat: str) -> tuple[str, str]:
    """The series of :func:`geo.lonlat_to_utm`, with its constants worked out here as there."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * n**0.5 / (1 + n)
    t = f"sinh(atanh(sin(radians({lat}))) - atanh(sin(radians({lat})) * {e!r}) * {e!r})"
    xi, eta = f"atan2({t}, cos(radians({lon} - 9.0)))", f"atanh(sin(radians({lon} - 9.0)) / sqrt(1 + pow({t}, 2)))"
    east = eta + "".join(f" + cos(({xi}) * {2 * j}) * sinh(({eta}) * {2 * j}) * {c!r}" for j, c in enumerate(alpha, 1))
    north = xi + "".join(f" + sin(({xi}) * {2 * j}) * cosh(({eta}) * {2 * j}) * {c!r}" for j, c in enumerate(alpha, 1))
    return f"({east}) * {scale!r} + 500000.0", f"({north}) * {scale!r}"


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    x, y = _utm_sql("lon", "lat")
    low = [f"WHEN coalesce(contains(lower(long_name), '{t.lower()}') OR lower(short_name) = '{t.lower()}' OR lower(city) = '{t.lower()}', false) THEN {k}" for k, t in enumerate(TERMS)]
    lon, lat = "degrees(x / 6378137.0)", "degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2)"
    cx, cy = _utm_sql("lon", "lat")
    known = f"{keys.clean_sql('source_crs')} IS NOT NULL"
    image = keys.tile_key_sql("image_path")
    return {
        "metadata_cleaned": f"""SELECT record_id, {_KEY} AS sheet, {keys.clean_sql('city')} AS city, CAST(CASE WHEN {_num('year')} <> 0 THEN {_num('year')} END AS INTEGER) AS year, {keys.clean_sql('source_crs')} AS source_crs,
            ({_num('ul_x')} + {_num('lr_x')}) / 2 AS center_x, ({_num('ul_y')} + {_num('lr_y')}) / 2 AS center_y, coalesce(crs_explicit, false) AS crs_explicit FROM real_tiles_metadata""",
        "year_extraction": f"SELECT record_id, coalesce(CAST(CASE WHEN {_num('year')} <> 0 THEN {_num('year')} END AS INTEGER), TRY_CAST(nullif(regexp_extract(longname, '([0-9]{{4}})', 1), '') AS INTEGER)) AS year FROM real_tiles_metadata",
        "dataset_summary": f"SELECT year, count(*) AS tiles, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north, count(DISTINCT city) AS cities FROM {_PLACED} GROUP BY year",
        "reprojected": f"SELECT tile_id, round({x}, 2) AS proj_x, round({y}, 2) AS proj_y FROM {_PLACED}",
        "metric_rectangles": f"""WITH c AS (SELECT tile_id, unnest([{{'x': ul_x, 'y': ul_y}}, {{'x': ul_x, 'y': lr_y}}, {{'x': lr_x, 'y': ul_y}}, {{'x': lr_x, 'y': lr_y}}], recursive := true) FROM new_all_tiles WHERE ul_x IS NOT NULL AND ul_y IS NOT NULL AND lr_x IS NOT NULL AND lr_y IS NOT NULL),
            g AS (SELECT tile_id, {lon} AS lon, {lat} AS lat FROM c), u AS (SELECT tile_id, {cx} AS px, {cy} AS py FROM g)
            SELECT tile_id, round(min(px), 2) AS minx_m, round(max(px), 2) AS maxx_m, round(min(py), 2) AS miny_m, round(max(py), 2) AS maxy_m FROM u GROUP BY tile_id""",
        "policy_exclude": f"SELECT tile_id, short_name, year FROM {_T} WHERE NOT {_OUT}",
        "policy_flags": f"""SELECT tile_id, 'war' AS rule_id, 'flag_for_reporting' AS action, 'war years' AS rationale FROM {_T} WHERE NOT {_OUT} AND year >= 1914 AND year <= 1918
            UNION ALL SELECT tile_id, 'market', 'flag_for_reporting', 'market town' FROM {_T} WHERE NOT {_OUT} AND regexp_matches(long_name, '(?i)\\(Markt\\)')""",
        "anchor_match": f"SELECT tile_id, term FROM (SELECT tile_id, CASE {' '.join(low)} END AS term FROM {_T}) WHERE term IS NOT NULL",
        "enrich_exact": f"WITH s AS (SELECT short_name AS sheet, min({keys.clean_sql('city')}) AS c FROM {_T} GROUP BY 1) SELECT record_id, sheet, coalesce(city, c) AS city FROM {_SHEETS} LEFT JOIN s USING (sheet)",
        "enrich_variant": f"""WITH src AS (SELECT short_name AS sheet, {keys.clean_sql('city')} AS c FROM {_T}), s AS (SELECT sheet, min(c) AS c FROM src GROUP BY 1),
            v AS (SELECT base, c AS vc FROM (SELECT regexp_replace(sheet, '[A-Z]+$', '') AS base, c, row_number() OVER (PARTITION BY regexp_replace(sheet, '[A-Z]+$', '') ORDER BY (sheet = regexp_replace(sheet, '[A-Z]+$', '')) DESC, (c IS NOT NULL) DESC, sheet) AS k FROM src WHERE sheet IS NOT NULL) WHERE k = 1)
            SELECT record_id, sheet, coalesce(city, c, vc) AS city FROM {_SHEETS} t LEFT JOIN s USING (sheet) LEFT JOIN v ON v.base = regexp_replace(t.sheet, '[A-Z]+$', '')""",
        "override_city": f"WITH f AS (SELECT {_KEY} AS short_name, min({keys.clean_sql('city')}) AS n FROM real_tiles_metadata WHERE source = 'city_overrides' AND {keys.clean_sql('city')} IS NOT NULL GROUP BY 1) SELECT tile_id, short_name, coalesce(n, city) AS city FROM {_T} LEFT JOIN f USING (short_name)",
        "crs_audit": f"""SELECT status, count(*) AS records, count(*) FILTER (WHERE data_quality = 'ok') AS ok_records, status IN ('explicit', 'derived') AS strict_ready FROM (
            SELECT *, CASE WHEN {known} AND crs_explicit THEN 'explicit' WHEN {known} AND {keys.clean_sql('crs_source')} IS NOT NULL THEN 'derived' WHEN {known} THEN 'assumed' ELSE 'missing' END AS status FROM real_tiles_metadata) GROUP BY status""",
        "duplicates": f"SELECT sheet, count(*) AS n, count(DISTINCT CASE WHEN ul_x IS NOT NULL AND ul_y IS NOT NULL THEN (ul_x, ul_y) END) AS positions FROM (SELECT {_KEY} AS sheet, ul_x, ul_y FROM real_tiles_metadata) WHERE sheet IS NOT NULL GROUP BY sheet HAVING count(*) > 1",
        "year_scope_audit": f"""SELECT 'before' AS scope, count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (WHERE year IS NULL) AS without_year FROM {_T}
            UNION ALL SELECT 'after', count(*), min(year), max(year), count(*) FILTER (WHERE year IS NULL) FROM {_T} WHERE NOT {_OUT}""",
        "align_audit": f"""WITH r AS (SELECT source, {_KEY} AS sheet, {_num('ul_x')} AS x, {_num('ul_y')} AS y FROM real_tiles_metadata), m AS (SELECT r.*, t.ul_x AS x0, sqrt(pow(x - t.ul_x, 2) + pow(y - t.ul_y, 2)) AS d FROM r LEFT JOIN new_all_tiles t ON t.shortname = r.sheet)
            SELECT source, count(*) AS records, count(*) FILTER (WHERE x IS NULL) AS missing, count(*) FILTER (WHERE x0 IS NULL) AS unmatched, count(*) FILTER (WHERE d > 1000) AS outliers, round(quantile_cont(d, 0.5), 3) AS median_offset FROM m GROUP BY source""",
        "handoff_checks": f"""SELECT patch_key, unnest(list_filter([CASE WHEN {keys.clean_sql('tile_shortname')} IS NULL THEN 'tile_empty' END, CASE WHEN {keys.clean_sql('image_path')} IS NULL THEN 'path_empty' END,
            CASE WHEN x1 <= x0 OR y1 <= y0 THEN 'bounds' END, CASE WHEN split_fold IS NOT NULL AND qc_status <> 'qc_passed' THEN 'fold_without_pass' END, CASE WHEN NOT (split_fold BETWEEN 1 AND 5) THEN 'fold_range' END,
            CASE WHEN x1 > tile_width_px OR y1 > tile_height_px THEN 'beyond_image' END], lambda r: r IS NOT NULL)) AS rule FROM selected_patches""",
        "tile_in_two_folds": f"SELECT sheet, count(DISTINCT split_fold) AS folds FROM (SELECT {keys.tile_key_sql('tile_shortname')} AS sheet, split_fold FROM selected_patches) WHERE sheet IS NOT NULL GROUP BY sheet HAVING count(DISTINCT split_fold) > 1",
        "fold_counts": f"SELECT split_fold, count(*) AS patches, count(DISTINCT {keys.tile_key_sql('tile_shortname')}) AS sheets FROM selected_patches WHERE qc_status = 'qc_passed' GROUP BY split_fold",
        "tree_compare": f"""WITH a AS (SELECT {image} AS path, sha256(min(city)) AS da FROM new_all_tiles WHERE image_path IS NOT NULL GROUP BY 1 HAVING path IS NOT NULL), b AS (SELECT {image} AS path, sha256(min(city)) AS db FROM real_tiles_metadata GROUP BY 1 HAVING path IS NOT NULL)
            SELECT path, CASE WHEN db IS NULL THEN 'only_a' WHEN da IS NULL THEN 'only_b' WHEN da = db THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b USING (path)""",
        "allow_list": f"SELECT DISTINCT {keys.tile_key_sql('tile_shortname')} AS short_name, {keys.tile_key_sql('tile_shortname')} IN (SELECT shortname FROM new_all_tiles WHERE shortname IS NOT NULL) AS found FROM selected_patches WHERE {keys.tile_key_sql('tile_shortname')} IS NOT NULL",
    }
