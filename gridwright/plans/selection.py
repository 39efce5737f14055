"""Queries on the candidate pool: distances, greedy choice, thinning, skyline, sweeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import keys
from gridwright.operators import objective, pairs, selection
from gridwright.session import table
from gridwright.sources.pool import candidate_pool, pool_sql

ALPHA, BETA, GAMMA, LEAST_KM, K = 0.4, 0.3, 0.3, 28.5, 5
#: Weights and distances of the sweep.
SWEEP = [(1, 0.4, 0.3, 0.3, 5, 28.5), (2, 0.6, 0.2, 0.2, 5, 28.5), (3, 0.2, 0.4, 0.4, 5, 45.0), (4, 0.34, 0.33, 0.33, 5, 10.0)]


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """The pool without features; the year read from the long name again."""
    df = candidate_pool(spark, sf)
    named = F.regexp_extract("long_name", r"([0-9]{4})", 1).try_cast("int")
    return df.select("row_id", "label", "center_x", "center_y", "year", "short_name", "long_name", named.alias("named_year"), "minx", "maxx", "miny", "maxy")


def pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Number, mean, least and greatest of each pair distance over the pool."""
    raw = pairs.unified(pairs.pool_pairs(candidate_pool(spark, sf)), ALPHA, BETA, GAMMA)
    kinds = ("visual", "cosine", "spatial_km", "edge_km", "years", "distance")
    long = raw.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("v")) for c in kinds])).alias("p")).select("p.*")
    return long.groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("v"), 6).alias("mean_value"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"))


def mean_visual_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cosine distance over all pairs, without pairs."""
    out = pairs.mean_cosine_distance(candidate_pool(spark, sf), "features", 64)
    return out.select("n", F.round("mean_distance", 6).alias("mean_distance"))


def nearest_neighbor(spark: SparkSession, sf: str) -> DataFrame:
    """The distance of each candidate's centre to the next one."""
    rows = candidate_pool(spark, sf)
    met = pairs.pairs(rows, "row_id", ["center_x", "center_y"])
    km = F.hypot(F.col("center_x_a") - F.col("center_x_b"), F.col("center_y_a") - F.col("center_y_b")) / 1000
    both = met.select(F.explode(F.array("row_id_a", "row_id_b")).alias("row_id"), km.alias("km"))
    return both.groupBy("row_id").agg(F.round(F.min("km"), 6).alias("nearest_km"))


def min_distance_rule(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum distance that nearest neighbours suggest: median, mean or 90 % of them, to half kilometres."""
    return objective.min_distance_rule(nearest_neighbor(spark, sf), "nearest_km")


def _chosen(spark: SparkSession, sf: str, mode: str, k: int = K, least: float = LEAST_KM, seeds: tuple[int, ...] = (), weights: tuple[float, float, float] = (ALPHA, BETA, GAMMA)) -> DataFrame:
    settings = spark.createDataFrame([(0, *weights, k, least)], selection.SETTINGS)
    out = selection.select(candidate_pool(spark, sf), settings, mode, seeds)
    return out.select("selection_rank", "row_id", F.round("gain", 6).alias("gain"))


def greedy_facility_location(spark: SparkSession, sf: str) -> DataFrame:
    """The default choice under the unified distance and an edge distance."""
    return _chosen(spark, sf, "unified")


def greedy_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """The same with two seeds."""
    return _chosen(spark, sf, "unified", seeds=(7, 3))


def greedy_constraint_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Choice by cosine similarity under a distance of centres."""
    return _chosen(spark, sf, "cosine")


def lazy_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Choice without constraint by lazy evaluation."""
    return _chosen(spark, sf, "lazy", least=0.0)


def farthest_point(spark: SparkSession, sf: str) -> DataFrame:
    """Choice of vectors far from each other."""
    return _chosen(spark, sf, "farthest", least=0.0).select("selection_rank", "row_id")


def spatial_thinning(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by id, each at least 150 km from those kept before."""
    return _chosen(spark, sf, "thinning", k=10_000, least=150.0).select("selection_rank", "row_id")


def weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Choices for several weights and distances side by side, with metrics and objective of each."""
    base = candidate_pool(spark, sf)
    settings = spark.createDataFrame(SWEEP, selection.SETTINGS)
    chosen = selection.select(base, settings)
    scored = objective.scored_selections(chosen, base, settings)
    return rounded_scores(scored)


#: What is shown of a scored selection, and the figures among it that are rounded.
SCORES = ("n_selected", "temporal_std", "temporal_range", "wwi_percent", "spatial_mean_km", "spatial_min_km", "clusters_covered", "diversity_norm", "spread_norm", "infeasible", "filled", "objective_score")
_ROUNDED = {"temporal_std", "wwi_percent", "spatial_mean_km", "spatial_min_km", "diversity_norm", "spread_norm", "filled", "objective_score"}


def rounded_scores(scored: DataFrame, run: str = "config_id") -> DataFrame:
    return scored.select(run, *[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in SCORES])


def scores_sql(chosen: str, run: str = "config_id") -> str:
    """The scores of selections in ``chosen`` (``run, row_id, k``), from the formula, for DuckDB; ``pool`` must be known."""
    shown = ", ".join(f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in SCORES)
    return f"""sel AS ({chosen}), mem AS (SELECT sel.{run}, sel.k, pool.* FROM sel JOIN pool USING (row_id)),
      one AS (SELECT {run}, any_value(k) AS k, count(*) AS n_selected, coalesce(stddev_samp(year), 0) AS temporal_std, coalesce(max(year) - min(year), 0) AS temporal_range,
        coalesce(100.0 * count(*) FILTER (WHERE year BETWEEN 1914 AND 1918) / nullif(count(year), 0), 0) AS wwi_percent, count(DISTINCT label) AS clusters_covered, coalesce((stddev_samp(center_x) + stddev_samp(center_y)) / 2, 0) AS spread FROM mem GROUP BY 1),
      two AS (SELECT a.{run}, avg(sqrt(pow(a.center_x - b.center_x, 2) + pow(a.center_y - b.center_y, 2))) / 1000 AS sm, min(sqrt(pow(a.center_x - b.center_x, 2) + pow(a.center_y - b.center_y, 2))) / 1000 AS sn,
        avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS diversity FROM mem a JOIN mem b ON a.{run} = b.{run} AND a.row_id < b.row_id GROUP BY 1),
      base AS (SELECT (SELECT avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) FROM pool a JOIN pool b ON a.row_id < b.row_id) AS bd, (SELECT (stddev_samp(center_x) + stddev_samp(center_y)) / 2 FROM pool) AS bs),
      raw_scores AS (SELECT one.*, coalesce(sm, 0) AS spatial_mean_km, coalesce(sn, 0) AS spatial_min_km, coalesce(diversity, 0) / bd AS diversity_norm, spread / bs AS spread_norm, n_selected < k AS infeasible, least(1.0, n_selected / k) AS filled FROM one LEFT JOIN two USING ({run}), base),
      scores AS (SELECT *, (diversity_norm + spread_norm) / 2 * CASE WHEN infeasible THEN filled * 0.1 ELSE 1 END AS objective_score FROM raw_scores)
      SELECT {run}, {shown} FROM scores"""


def seed_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Jaccard overlap of the choices of the sweep."""
    chosen = selection.select(candidate_pool(spark, sf), spark.createDataFrame(SWEEP, selection.SETTINGS))
    sets = chosen.groupBy("config_id").agg(F.collect_set("row_id").alias("ids"))
    a, b = sets.alias("a"), sets.alias("b")
    met = a.join(b, F.col("a.config_id") < F.col("b.config_id"))
    return met.select(F.col("a.config_id").alias("config_a"), F.col("b.config_id").alias("config_b"), F.round(objective.jaccard(F.col("a.ids"), F.col("b.ids")), 6).alias("jaccard"))


def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that none beats in size and price at once, price to be small."""
    return selection.pareto_front(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size"], ["p_retailprice"])


def core_case(spark: SparkSession, sf: str) -> DataFrame:
    """The selected sheets: core ones that aren't cases too, the cases behind them, ranked anew."""
    df = table(spark, sf, "selected_patches").select(keys.tile_key(F.col("tile_shortname")).alias("sheet"), "selection_group", "selection_rank").where("sheet is not null")
    sheets = df.groupBy("sheet", "selection_group").agg(F.min("selection_rank").alias("selection_rank"))
    return selection.core_and_cases(sheets.where("selection_group = 'core'"), sheets.where("selection_group = 'case'"), "sheet", "selection_rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    named = (pool, pair_summary, mean_visual_distance, nearest_neighbor, min_distance_rule, greedy_facility_location, greedy_seeded, greedy_constraint_cosine, lazy_greedy, farthest_point, spatial_thinning, weight_sweep, seed_stability, pareto_front, core_case)
    return {f.__name__: f for f in named}


_POOL = f"({pool_sql()})"
_RAW = f"""pool AS MATERIALIZED ({pool_sql()}),
raw AS MATERIALIZED (
  SELECT a.row_id AS i, b.row_id AS j, sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS visual,
    least(greatest(1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 0), 1) AS cosine,
    sqrt((a.center_x - b.center_x) * (a.center_x - b.center_x) + (a.center_y - b.center_y) * (a.center_y - b.center_y)) / 1000 AS spatial_km,
    sqrt(pow(greatest(a.minx - b.maxx, b.minx - a.maxx, 0), 2) + pow(greatest(a.miny - b.maxy, b.miny - a.maxy, 0), 2)) / 1000 AS edge_km,
    CAST(abs(a.year - b.year) AS DOUBLE) AS years
  FROM pool a, pool b {{where}}),
most AS (SELECT max(visual) AS v, max(spatial_km) AS s, max(years) AS y FROM raw),
unified AS MATERIALIZED (SELECT raw.*, {ALPHA} * visual / v + {BETA} * spatial_km / s + {GAMMA} * years / y AS distance FROM raw, most)"""


def _greedy_sql(similarity: str, apart: str, least: float, k: int, seeds: tuple[int, ...] = (), sim_sql: str | None = None) -> str:
    """A chain of steps: the best candidate, then the best similarity of each row to the choice."""
    parts = [_RAW.format(where=""), sim_sql or f"sim AS MATERIALIZED (SELECT i, j, {similarity} AS sm, {apart} AS apart FROM unified, (SELECT max(distance) AS most_d FROM unified))"]
    parts.append("m0 AS (SELECT DISTINCT j, CAST(NULL AS DOUBLE) AS cur FROM sim)")
    for step in range(k):
        chosen = " UNION ALL ".join(f"SELECT row_id FROM s{q}" for q in range(step)) or "SELECT -1 AS row_id"
        blocked = f"SELECT i FROM sim WHERE apart < {least} AND j IN ({chosen})" if least > 0 else chosen
        only = f"sim.i = {seeds[step]}" if step < len(seeds) else f"sim.i NOT IN ({blocked}) AND sim.i NOT IN ({chosen})"
        parts.append(f"""s{step} AS MATERIALIZED (SELECT {step} AS rk, sim.i AS row_id, round(sum(CASE WHEN cur IS NULL THEN sm ELSE greatest(0, sm - cur) END), 9) AS gain
          FROM sim JOIN m{step} USING (j) WHERE {only} GROUP BY sim.i ORDER BY gain DESC, row_id LIMIT 1)""")
        parts.append(f"""m{step + 1} AS MATERIALIZED (SELECT m{step}.j, CASE WHEN m{step}.cur IS NULL THEN sim.sm ELSE greatest(m{step}.cur, sim.sm) END AS cur
          FROM m{step} JOIN sim ON sim.j = m{step}.j AND sim.i = (SELECT row_id FROM s{step}))""")
    rows = " UNION ALL ".join(f"SELECT rk AS selection_rank, row_id, round(gain, 6) AS gain FROM s{q}" for q in range(k))
    return f"WITH {', '.join(parts)} {rows}"


def _sweep_sql() -> str:
    """The greedy chains of the sweep's settings, one behind the other, and their scores."""
    told = f"{ALPHA} * visual / v + {BETA} * spatial_km / s + {GAMMA} * years / y"
    chains = []
    for config, a, b, g, k, least in SWEEP:
        chain = _greedy_sql("most_d - distance", "edge_km", least, k).replace(told, f"{a} * visual / v + {b} * spatial_km / s + {g} * years / y")
        chains.append(f"SELECT {config} AS config_id, row_id, {k} AS k FROM ({chain})")
    return f"WITH pool AS MATERIALIZED ({pool_sql()}), {scores_sql(' UNION ALL '.join(chains))}"


_NEAREST = f"""SELECT a.row_id, round(min(sqrt((a.center_x - b.center_x) * (a.center_x - b.center_x) + (a.center_y - b.center_y) * (a.center_y - b.center_y)) / 1000), 6) AS nearest_km
FROM {_POOL} a JOIN {_POOL} b ON a.row_id <> b.row_id GROUP BY a.row_id"""


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query name."""
    kinds = ("visual", "cosine", "spatial_km", "edge_km", "years", "distance")
    summary = " UNION ALL ".join(f"SELECT '{c}' AS kind, count(*) AS pairs, round(avg({c}), 6) AS mean_value, round(min({c}), 6) AS least, round(max({c}), 6) AS most FROM unified" for c in kinds)
    cosine = "sim AS MATERIALIZED (SELECT i, j, 1 - CASE WHEN i = j THEN 0 ELSE cosine END AS sm, spatial_km AS apart FROM raw)"
    return {
        "pool": f"SELECT row_id, label, center_x, center_y, year, short_name, long_name, TRY_CAST(regexp_extract(long_name, '([0-9]{{4}})', 1) AS INT) AS named_year, minx, maxx, miny, maxy FROM {_POOL}",
        "pair_summary": f"WITH {_RAW.format(where='WHERE a.row_id < b.row_id')} {summary}",
        "mean_visual_distance": f"WITH {_RAW.format(where='WHERE a.row_id < b.row_id')} SELECT (SELECT count(*) FROM pool) AS n, (SELECT round(avg(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) FROM pool a JOIN pool b ON a.row_id < b.row_id) AS mean_distance",
        "nearest_neighbor": _NEAREST,
        "min_distance_rule": objective.min_distance_rule_sql(_NEAREST, "nearest_km"),
        "greedy_facility_location": _greedy_sql("most_d - distance", "edge_km", LEAST_KM, K),
        "greedy_seeded": _greedy_sql("most_d - distance", "edge_km", LEAST_KM, K, (7, 3)),
        "greedy_constraint_cosine": _greedy_sql("", "", LEAST_KM, K, sim_sql=cosine),
        "lazy_greedy": _greedy_sql("most_d - distance", "edge_km", 0.0, K),
        "farthest_point": f"""WITH RECURSIVE p AS (SELECT row_id, CAST(embedding AS DOUBLE[]) AS e FROM {_POOL}),
          first AS (SELECT row_id, e FROM p ORDER BY round(list_var_pop(e), 9) DESC, row_id LIMIT 1),
          steps AS (
            SELECT 0 AS selection_rank, (SELECT row_id FROM first) AS row_id, (SELECT list([row_id]) FROM first) AS taken,
              (SELECT list({{'id': p.row_id, 'd': list_distance(p.e, first.e)}}) FROM p, first WHERE p.row_id <> first.row_id) AS near
            UNION ALL
            SELECT s.selection_rank + 1, n.id, NULL, (SELECT list({{'id': x.id, 'd': least(x.d, list_distance(p.e, c.e))}}) FROM (SELECT unnest(s.near) AS x) JOIN p ON p.row_id = x.id, (SELECT e FROM p WHERE row_id = n.id) c WHERE x.id <> n.id)
            FROM steps s, (SELECT x.id FROM (SELECT unnest(s.near) AS x) ORDER BY round(x.d, 9) DESC, x.id LIMIT 1) n WHERE s.selection_rank < {K - 1})
          SELECT selection_rank, row_id FROM steps""",
        "spatial_thinning": f"""WITH RECURSIVE p AS (SELECT row_id, center_x / 1000 AS x, center_y / 1000 AS y FROM {_POOL}),
          steps AS (
            SELECT 0 AS selection_rank, (SELECT min(row_id) FROM p) AS row_id,
              (SELECT list(p.row_id ORDER BY p.row_id) FROM p, (SELECT x, y FROM p ORDER BY row_id LIMIT 1) f WHERE sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y)) >= 150.0) AS left_ids
            UNION ALL
            SELECT s.selection_rank + 1, s.left_ids[1],
              (SELECT list(p.row_id ORDER BY p.row_id) FROM (SELECT unnest(s.left_ids) AS id) l JOIN p ON p.row_id = l.id, (SELECT x, y FROM p WHERE row_id = s.left_ids[1]) f
               WHERE sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y)) >= 150.0)
            FROM steps s WHERE len(s.left_ids) > 0)
          SELECT selection_rank, row_id FROM steps""",
        "weight_sweep": _sweep_sql(),
        "pareto_front": "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))",
        "core_case": f"""WITH p AS (SELECT {keys.tile_key_sql('tile_shortname')} AS sheet, selection_group, min(selection_rank) AS r FROM selected_patches WHERE selection_group IN ('core', 'case') GROUP BY 1, 2 HAVING sheet IS NOT NULL),
          u AS (SELECT sheet, 'core' AS selection_group, 0 AS g, r FROM p WHERE selection_group = 'core' AND sheet NOT IN (SELECT sheet FROM p WHERE selection_group = 'case') UNION ALL SELECT sheet, 'case', 1, r FROM p WHERE selection_group = 'case')
          SELECT sheet, selection_group, row_number() OVER (ORDER BY g, r, sheet) - 1 AS selection_rank FROM u""",
    }
