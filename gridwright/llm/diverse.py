"""A varied subset of given size by round-robin over a grid of many attributes, in SQL only.

Records are put into cells by their binned features. In each cell they are ranked at random; the ranks then order the whole
table: first the first record of each cell, cell by cell in random order, then the second, until the size is reached. A cell
with a third of all records so gives no more than its neighbours until these are used up.

The SQL runs in Spark and, with the dialect's names put in, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwright.functions.keys import NO_VALUE

YEAR_BIN, DEGREE_BIN, SIZE = 10, 2.0, 1000

_WORDS = ", ".join("'" + w + "'" for w in NO_VALUE)

#: Both pools in one shape. Sheet corners of the records are in metres, kilometres, feet or degrees, told by the width.
POOL = """
SELECT 'tile' AS pool, CAST(tile_id AS BIGINT) AS record_id, CAST(year AS DOUBLE) AS year, city,
  CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0) THEN lon END AS lon,
  CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0) THEN lat END AS lat
FROM new_all_tiles WHERE tile_id IS NOT NULL
UNION ALL
SELECT 'record' AS pool, CAST(record_id AS BIGINT) AS record_id, year, city,
  CASE WHEN wide < 5 THEN x ELSE x * unit / 111319.49079327358 END AS lon,
  CASE WHEN wide < 5 THEN y ELSE degrees(2 * atan(exp(y * unit / 6378137.0)) - pi() / 2) END AS lat
FROM (
  SELECT record_id, year, city, (ul_x + lr_x) / 2 AS x, (ul_y + lr_y) / 2 AS y, abs(lr_x - ul_x) AS wide,
    CASE WHEN abs(lr_x - ul_x) < 5 THEN 111319.49079327358 WHEN abs(lr_x - ul_x) < 1000 THEN 1000.0
         WHEN abs(lr_x - ul_x) < 100000 THEN 1.0 ELSE 0.3048 END AS unit
  FROM real_tiles_metadata WHERE record_id IS NOT NULL) AS corners
"""

#: The cells of the records: decade, city in one spelling, and a square of longitude and latitude; null where missing.
CELLS = """
SELECT pool, record_id,
  concat_ws('|',
    coalesce(CAST(TRY_CAST(floor(CASE WHEN year > 0 AND year < 1e6 THEN year END / {year_bin}) AS BIGINT) AS {string}), '-'),
    CASE WHEN lower(trim(coalesce(city, ''))) IN ({words}) THEN '-'
      ELSE replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(trim(city)), '_', ' '), '-', ' '), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') END,
    coalesce(CAST(TRY_CAST(floor(CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 THEN lon END / {degree_bin}) AS BIGINT) AS {string}), '-'),
    coalesce(CAST(TRY_CAST(floor(CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 THEN lat END / {degree_bin}) AS BIGINT) AS {string}), '-')) AS cell,
  md5(concat(pool, ':', CAST(record_id AS {string}), ':{seed}')) AS draw
FROM ({pool}) AS pool_rows
"""

#: Ranks in two steps. A cell is cut by the first digits of the draw, so its records are ranked by up to 256 tasks; only the
#: first {size} of each part can be among the first {size} of the cell, so no more reach the second ranking.
CHOICE = """
WITH cells AS ({cells}),
parts AS (
  SELECT *, row_number() OVER (PARTITION BY cell, substr(draw, 1, 2) ORDER BY draw, pool, record_id) AS part_rank FROM cells),
ranked AS (
  SELECT pool, record_id, cell, draw, row_number() OVER (PARTITION BY cell ORDER BY draw, pool, record_id) AS cell_rank
  FROM parts WHERE part_rank <= {size})
SELECT pool, record_id, cell, CAST(cell_rank AS BIGINT) AS cell_rank FROM ranked WHERE cell_rank <= {size}
ORDER BY cell_rank, md5(cell), cell, pool, record_id LIMIT {size}
"""


def choice_sql(string: str = "VARCHAR", pool: str = POOL, size: int = SIZE, year_bin: int = YEAR_BIN, degree_bin: float = DEGREE_BIN, seed: int = 1) -> str:
    cells = CELLS.format(pool=pool, string=string, year_bin=year_bin, degree_bin=degree_bin, seed=seed, words=_WORDS)
    return CHOICE.format(cells=cells, size=size)


def choose_varied(spark: SparkSession, tiles: DataFrame, records: DataFrame, size: int = SIZE, year_bin: int = YEAR_BIN, degree_bin: float = DEGREE_BIN, seed: int = 1) -> DataFrame:
    """``pool, record_id, cell, cell_rank`` of the records chosen, ``size`` of them or all if there are fewer.

    Missing or impossible years, cities and positions form bins of their own. Null ids are left out. Ids given twice are
    two records. Ties are ordered by id. Empty tables give an empty result. The limit is the feature.
    """
    text = choice_sql("STRING", POOL, size, year_bin, degree_bin, seed)
    text = text.replace("FROM new_all_tiles", "FROM {tiles}").replace("FROM real_tiles_metadata", "FROM {records}")
    return spark.sql(text, tiles=tiles, records=records)
