"""The candidate pool: records with a key, features, a position, an extent and a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.session import table

#: Metres from a candidate's centre to its sides.
HALF_EXTENT = 15000.0

#: The pool by integer arithmetic on the embeddings, the same text for Spark and DuckDB; {text} is the name of the text type.
POOL_SQL = """
SELECT row_id, label, embedding, center_x, center_y, year, short_name, concat(short_name, '_City', CAST(row_id % 97 AS {text}), '_', CAST(year AS {text})) AS long_name,
  center_x - {half} AS minx, center_x + {half} AS maxx, center_y - {half} AS miny, center_y + {half} AS maxy
FROM (
  SELECT vec_id AS row_id, label, embedding,
    400000.0E0 + (vec_id * vec_id * 31 + vec_id * 7919) % 997 * 500.0E0 AS center_x,
    5600000.0E0 + (vec_id * vec_id * 17 + vec_id * 10477) % 1009 * 500.0E0 AS center_y,
    CAST(1880 + (vec_id * 31) % 66 AS INT) AS year,
    concat('KDR_', lpad(CAST(vec_id % 1000 AS {text}), 3, '0'), CASE WHEN vec_id >= 1000 THEN 'b' ELSE '' END) AS short_name
  FROM embeddings) AS derived
"""


def pool_sql(half: float = HALF_EXTENT, text: str = "VARCHAR") -> str:
    return POOL_SQL.format(half=f"{half:.1f}E0", text=text)


def candidate_pool(spark: SparkSession, sf: str, half: float = HALF_EXTENT) -> DataFrame:
    """The pool, with ``features`` as doubles; one row for each embedding."""
    text = pool_sql(half, "STRING").replace("FROM embeddings", "FROM {embeddings}")
    pool = spark.sql(text, embeddings=table(spark, sf, "embeddings"))
    return pool.withColumn("features", F.col("embedding").cast("array<double>")).drop("embedding")
