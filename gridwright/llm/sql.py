"""The same results in DuckDB's SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from gridwright.functions.keys import NO_VALUE, clean_sql, tile_key_sql
from gridwright.llm import diverse

_WORDS = ", ".join("'" + w + "'" for w in NO_VALUE)


def _category(name: str, value: str) -> str:
    text = f"lower(trim(regexp_replace(CAST({value} AS VARCHAR), '[ \t\r\n]', ' ', 'g')))"
    whole = f"coalesce(CAST(CAST(TRY_CAST(trim(CAST({value} AS VARCHAR)) AS DOUBLE) AS BIGINT) AS VARCHAR), {text})"
    sheet = f"coalesce({tile_key_sql(f'CAST({value} AS VARCHAR)')}, {text})"
    return f"nullif(CASE {name} WHEN 'tile_shortname' THEN {sheet} WHEN 'class_id' THEN {whole} ELSE {text} END, '')"


_P1 = f"""
WITH tasks AS (
  SELECT run_id, task_key, class_id, tile_shortname, pass_type FROM (
    SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY ingested_at DESC, recorded_at DESC) AS k FROM width_tasks) WHERE k = 1 AND task_key IS NOT NULL),
there AS (
  SELECT run_id, field_name, key, count(*) AS n FROM (
    SELECT run_id, 'class_id' AS field_name, {_category("'class_id'", "class_id")} AS key FROM tasks
    UNION ALL SELECT run_id, 'tile_shortname', {_category("'tile_shortname'", "tile_shortname")} FROM tasks
    UNION ALL SELECT run_id, 'pass_type', {_category("'pass_type'", "pass_type")} FROM tasks)
  WHERE key IS NOT NULL GROUP BY ALL),
report AS (
  SELECT t.run_id, t.field_name, t.category, greatest(coalesce(t.min_count, 0), coalesce(t.sample_size, 0) * coalesce(t.target_pct, 0) / 100.0) AS required, coalesce(there.n, 0) AS available
  FROM (SELECT *, {_category("field_name", "category")} AS key FROM sampling_targets WHERE run_id IS NOT NULL) t
  LEFT JOIN there USING (run_id, field_name, key))
"""
P1_FOUND = _P1 + "SELECT run_id, field_name, category FROM report WHERE available < required"
P1_TARGETS = _P1 + "SELECT run_id, field_name, category, round(CAST(required AS DOUBLE), 6) AS required, available, available < required AS short FROM report"


def _near(x: str, y: str) -> str:
    return f"abs({x} - {y}) <= 0.001 * greatest(1.0, {y})"


_KINDS = ("train_val", "train_test", "val_test")
_STATE = ", ".join(
    f"CASE WHEN recorded_min_{t}_km IS NULL AND min_{t}_km IS NOT NULL THEN 'not recorded' WHEN recorded_min_{t}_km IS NULL OR coalesce({_near(f'recorded_min_{t}_km', f'min_{t}_km')}, false) THEN 'agrees' "
    f"WHEN min_{t}_km > 0 AND ({_near(f'recorded_min_{t}_km', f'min_{t}_km * 1000')} OR abs(recorded_min_{t}_km * 1000 - min_{t}_km) <= 0.001 * min_{t}_km) THEN 'mis-scaled' ELSE 'stale' END"
    for t in _KINDS
)
P3_MINIMA = f"""
WITH r AS (
  SELECT record_id, run_id, CASE WHEN s IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN s IN ('test', 'testing') THEN 'test' WHEN s IN ('train', 'training') THEN 'train' END AS split, ul_x, ul_y, lr_x, lr_y
  FROM (SELECT *, lower(trim(split_name)) AS s FROM split_records) WHERE record_id IS NOT NULL AND NOT isnan(ul_x) AND NOT isnan(ul_y) AND NOT isnan(lr_x) AND NOT isnan(lr_y) AND lr_x >= ul_x AND ul_y >= lr_y),
p AS (
  SELECT a.run_id, CASE WHEN 'train' IN (a.split, b.split) THEN CASE WHEN 'val' IN (a.split, b.split) THEN 'train_val' ELSE 'train_test' END ELSE 'val_test' END AS kind,
    sqrt(pow(greatest(a.ul_x - b.lr_x, b.ul_x - a.lr_x, 0), 2) + pow(greatest(a.lr_y - b.ul_y, b.lr_y - a.ul_y, 0), 2)) / 1000 AS km
  FROM r a JOIN r b ON a.run_id = b.run_id AND a.record_id < b.record_id AND a.split <> b.split),
m AS (SELECT run_id, {", ".join(f"round(min(km) FILTER (WHERE kind = '{t}'), 6) AS min_{t}_km" for t in _KINDS)}, count(*) FILTER (WHERE km < d_leak_km) AS near_pairs FROM p JOIN split_audits USING (run_id) GROUP BY run_id),
b AS (
  SELECT run_id, coalesce(near_pairs, 0) AS near_pairs, {", ".join(f"m.min_{t}_km" for t in _KINDS)}, violations_count, {", ".join(f"CASE WHEN NOT isnan(a.min_{t}_km) THEN a.min_{t}_km END AS recorded_min_{t}_km" for t in _KINDS)}
  FROM split_audits a LEFT JOIN m USING (run_id)),
c AS (SELECT *, [{_STATE}] AS states FROM b)
SELECT * EXCLUDE (states), CASE WHEN list_contains(states, 'stale') THEN 'stale' WHEN list_contains(states, 'mis-scaled') THEN 'mis-scaled' WHEN list_contains(states, 'not recorded') THEN 'not recorded' ELSE 'agrees' END AS status FROM c
"""


def _has(value: str) -> str:
    return f"(CASE WHEN {clean_sql(f'CAST({value} AS VARCHAR)')} IS NULL THEN 0 ELSE 1 END)"


P4_FOUND = f"""
WITH r AS (
  SELECT record_id, recorded_at, coalesce(trust_rank, 2147483647) AS trust,
    coalesce({tile_key_sql("shortname")}, {tile_key_sql("longname")}, {tile_key_sql("filename")}, {tile_key_sql("image_path")}) AS tile,
    {_has("city")} + (CASE WHEN year IS NULL OR isnan(year) OR year = 0 THEN 0 ELSE 1 END) + {_has("filename")}
    + (CASE WHEN ul_x IS NULL OR isnan(ul_x) THEN 0 ELSE 1 END) + (CASE WHEN pixel_width IS NULL OR isnan(pixel_width) THEN 0 ELSE 1 END) + {_has("source_crs")} AS present
  FROM real_tiles_metadata LEFT JOIN source_trust USING (source) WHERE record_id IS NOT NULL)
SELECT min(record_id) AS group_id, first(record_id ORDER BY present DESC, trust, recorded_at DESC NULLS LAST, record_id) AS best_id
FROM r WHERE tile IS NOT NULL GROUP BY tile HAVING count(DISTINCT record_id) >= 2
"""

_TILE = f"coalesce({tile_key_sql('tile_shortname')}, upper({clean_sql('tile_shortname')}))"
_IMAGE = f"coalesce({tile_key_sql('image_path')}, upper(trim(regexp_replace(regexp_replace({clean_sql('image_path')}, '^.*[\\\\/]', ''), '\\.[A-Za-z]{{2,4}}$', ''))))"

_P6 = f"""
WITH RECURSIVE p AS (
  SELECT patch_key, split_fold, 'tile:' || {_TILE} AS tile, 'image:' || {_IMAGE} AS image FROM selected_patches WHERE patch_key IS NOT NULL),
links AS (
  SELECT DISTINCT tile AS a, image AS b FROM p WHERE tile IS NOT NULL AND image IS NOT NULL
  UNION SELECT DISTINCT image, tile FROM p WHERE tile IS NOT NULL AND image IS NOT NULL),
reach AS (
  SELECT DISTINCT a, a AS b FROM links
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
members AS (
  SELECT patch_key, split_fold, coalesce(root, tile, image, 'item:' || patch_key) AS component
  FROM p LEFT JOIN roots ON roots.node = coalesce(p.tile, p.image))
"""
P6_FOUND = _P6 + "SELECT min(patch_key) AS group_id FROM members GROUP BY component HAVING count(DISTINCT split_fold) > 1"
P6_GROUPS = _P6 + "SELECT min(patch_key) AS group_id, count(*) AS patches, CAST(count(DISTINCT split_fold) AS INTEGER) AS folds FROM members GROUP BY component"

P10_STATS = r"""
WITH w AS (SELECT list(DISTINCT lower(word)) AS words FROM common_words WHERE regexp_full_match(word, '\p{L}+')),
t AS (
  SELECT doc_id, text, regexp_extract_all(text, '\p{L}+') AS found, length(text) AS size,
    length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
    length(text) - length(regexp_replace(text, '[^\p{L}\p{N} \t\r\n.,;:!?''"()\-]', '', 'g')) AS symbols,
    len(regexp_extract_all(text, '[^ \t\r\n][^\r\n]*')) AS lines,
    len(regexp_extract_all(text, '[.!?][ \t]*(?:\r|\n|\z)')) AS ended FROM documents)
SELECT doc_id, CAST(len(found) AS INTEGER) AS words,
  CASE WHEN len(found) > 0 THEN round(letters / len(found), 6) END AS mean_word_length,
  CASE WHEN size > 0 THEN round(symbols / size, 6) END AS symbol_ratio,
  CASE WHEN lines > 0 THEN round(ended / lines, 6) END AS ended_line_share,
  CASE WHEN len(found) > 0 THEN round(len(list_filter(found, lambda x: list_contains(words, lower(x)))) / len(found), 6) END AS common_word_share
FROM t, w
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    return {"p1_found": P1_FOUND, "p1_targets": P1_TARGETS, "p3_minima": P3_MINIMA, "p4_found": P4_FOUND, "p5_varied": diverse.choice_sql(), "p6_found": P6_FOUND, "p6_groups": P6_GROUPS, "p10_stats": P10_STATS}
