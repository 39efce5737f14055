"""Metrics of selections, the normalised objective, and choices among trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.operators.pairs import dot, euclidean, feature_pairs, norm

#: Fixed value: the years counted as war years.
WAR_YEARS = (1914, 1918)
DEFAULT_DISTANCE_KM = 28.0


def war_share(year: Column) -> Column:
    """The percentage of war years among the years that aren't null, 0 if all are."""
    return F.coalesce(F.try_divide(F.count_if(year.between(*WAR_YEARS)) * 100.0, F.count(year).cast("double")), F.lit(0.0))


def selection_metrics(selected: DataFrame, run: str) -> DataFrame:
    """One row a run: size, spread of the years (sample deviation, 0 for one), range (0 for one or none), share of war years
    among the years known (0 for none), mean and least distance of centres in km (0 for one), clusters covered.

    ``selected`` has the run, row_id, center_x, center_y, year and label. The members of a run meet as two sides of an
    equi-join on the run; a selection is small by its nature.
    """
    one = selected.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_selected"), F.coalesce(F.stddev_samp("year"), F.lit(0.0)).alias("temporal_std"), F.coalesce(F.max("year") - F.min("year"), F.lit(0)).alias("temporal_range"),
        war_share(F.col("year")).alias("wwi_percent"), F.count_distinct("label").alias("clusters_covered"),
    )
    side = lambda s: selected.select(run, *[F.col(c).alias(f"{c}{s}") for c in ("row_id", "center_x", "center_y")])
    met = side("_a").join(side("_b"), run).where("row_id_a < row_id_b")
    km = F.hypot(F.col("center_x_a") - F.col("center_x_b"), F.col("center_y_a") - F.col("center_y_b")) / 1000
    apart = met.groupBy(run).agg(F.avg(km).alias("spatial_mean_km"), F.min(km).alias("spatial_min_km"))
    return one.join(apart, run, "left").fillna(0.0, ["spatial_mean_km", "spatial_min_km"])


def spread(df: DataFrame, *groups: str) -> DataFrame:
    """``spread_m``: the mean of the sample deviations of x and y; null for one row."""
    return df.groupBy(*groups).agg(((F.stddev_samp("center_x") + F.stddev_samp("center_y")) / 2).alias("spread_m"))


def mean_feature_distance(selected: DataFrame, run: str, metric: str = "euclidean") -> DataFrame:
    """``run, diversity``: the mean distance of the feature vectors of each two members of a run; a run of one gives none.

    The members of a run meet by an equi-join on the run; a selection is small by its nature.
    """
    side = lambda s: selected.select(run, F.col("row_id").alias(f"id{s}"), F.col("features").alias(f"f{s}"))
    apart = euclidean("f_a", "f_b") if metric == "euclidean" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot("f_a", "f_b") / F.when(norm("f_a") * norm("f_b") == 0, 1.0).otherwise(norm("f_a") * norm("f_b"))))
    return side("_a").join(side("_b"), run).where("id_a < id_b").groupBy(run).agg(F.avg(apart).alias("diversity"))


def baselines(pool: DataFrame) -> DataFrame:
    """One row: ``base_diversity``, the mean Euclidean feature distance over all pairs of the pool (by blocks of matrices), and
    ``base_spread``; what isn't positive counts as 1."""
    positive = lambda c: F.coalesce(F.when(c > 0, c), F.lit(1.0))
    mean = feature_pairs(pool, "row_id", ["features"]).agg(positive(F.avg("features")).alias("base_diversity"))
    return mean.crossJoin(spread(pool).select(positive(F.col("spread_m")).alias("base_spread")))  # one row each


def normalised_objective(scored: DataFrame, base: DataFrame, diversity: float = 0.5, spatial: float = 0.5, penalty: float = 0.1) -> DataFrame:
    """Add ``diversity_norm``, ``spread_norm``, ``objective_raw``, ``infeasible``, ``filled`` and ``objective_score``.

    ``scored`` has ``diversity`` and ``spread_m`` of each selection, how many it has (``n_selected``) and should have (``k``);
    ``base`` is the row of :func:`baselines`. The score is the weighted sum of both over their baselines, and a tenth of the
    filled share of it where fewer than ``k`` were selected. A missing diversity or spread counts as 0.
    """
    if diversity + spatial <= 0:
        raise ValueError("the weights must have a positive sum")
    both = scored.crossJoin(F.broadcast(base))  # one row
    both = both.withColumn("diversity_norm", F.coalesce("diversity", F.lit(0.0)) / F.col("base_diversity")).withColumn("spread_norm", F.coalesce("spread_m", F.lit(0.0)) / F.col("base_spread"))
    both = both.withColumn("objective_raw", (F.col("diversity_norm") * diversity + F.col("spread_norm") * spatial) / (diversity + spatial))
    filled = F.when(F.col("k") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("n_selected") / F.when(F.col("k") > 0, F.col("k"))))).otherwise(0.0)
    both = both.withColumn("infeasible", F.col("n_selected") < F.col("k")).withColumn("filled", filled)
    return both.withColumn("objective_score", F.when(F.col("infeasible"), F.col("objective_raw") * F.col("filled") * penalty).otherwise(F.col("objective_raw"))).drop("base_diversity", "base_spread")


def scored_selections(chosen: DataFrame, pool: DataFrame, targets: DataFrame, run: str = "config_id") -> DataFrame:
    """Metrics and objective of each run of ``chosen`` (``run, row_id``); ``targets`` has the size ``k`` each should have."""
    members = chosen.select(run, "row_id").join(pool, "row_id")
    scored = selection_metrics(members, run).join(spread(members, run), run).join(mean_feature_distance(members, run), run, "left").join(targets.select(run, "k"), run)
    return normalised_objective(scored, baselines(pool))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; two empty ones are alike, an empty and another not."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def min_distance_rule(nearest: DataFrame, km: str) -> DataFrame:
    """``n, median_km, mean_km, p90_km``: figures of nearest distances to the next half kilometre (half to even); 28 if there
    are fewer than two."""
    half = lambda c: F.when(F.count(km) < 2, DEFAULT_DISTANCE_KM).otherwise(F.bround(c * 2) / 2)
    return nearest.agg(F.count(km).alias("n"), half(F.expr(f"percentile({km}, 0.5)")).alias("median_km"), half(F.avg(km)).alias("mean_km"), half(F.expr(f"percentile({km}, 0.9)")).alias("p90_km"))


def min_distance_rule_sql(nearest: str, km: str) -> str:
    half = lambda c: f"CASE WHEN count({km}) < 2 THEN {DEFAULT_DISTANCE_KM} ELSE round_even(({c}) * 2, 0) / 2 END"
    return f"SELECT count({km}) AS n, {half(f'quantile_cont({km}, 0.5)')} AS median_km, {half(f'avg({km})')} AS mean_km, {half(f'quantile_cont({km}, 0.9)')} AS p90_km FROM ({nearest})"


def running_best(trials: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Add ``best``, the largest value up to each trial of its group."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best", F.max(value).over(upto))


def first_within(trials: DataFrame, group: str, order: str, value: str, share: float = 0.99) -> DataFrame:
    """``trials, best, reached``: the first trial at which the running best is at ``share`` of the group's best, which is the
    first trial that has as much itself; so two aggregations do, and no task holds a group."""
    whole = trials.groupBy(group).agg(F.max(value).alias("best"), F.count(F.lit(1)).alias("trials"))
    return trials.join(whole, group).groupBy(group).agg(F.first("trials").alias("trials"), F.first("best").alias("best"), F.min(F.when(F.col(value) >= F.col("best") * share, F.col(order))).alias("reached"))


def plateau(trials: DataFrame, drop: float = 0.03) -> DataFrame:
    """The smallest n among feasible trials within ``drop`` of the best feasible value, then the best value, then the lowest number."""
    good = trials.where("feasible")
    best = good.agg(F.max("value").alias("_best"))
    near = good.crossJoin(F.broadcast(best)).where(F.col("value") >= F.col("_best") * (1 - drop)).drop("_best")  # one row
    return near.orderBy("n", F.desc("value"), "number").limit(1)


def recommend_distance(summary: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """The smallest distance among those within all tolerances of the row that leads by the figures in their order."""
    lead = summary.orderBy(*[F.desc(c) for c in tolerances], "distance").limit(1).select(*[F.col(c).alias(f"_{c}") for c in tolerances])
    near = summary.crossJoin(F.broadcast(lead))  # one row
    for c, t in tolerances.items():
        near = near.where(F.col(c) >= F.col(f"_{c}") - t)
    return near.agg(F.min("distance").alias("recommended_distance"))


def patience(trials: DataFrame, order: str, value: str, least_gain: float, patience_: int) -> DataFrame:
    """Add ``stale``, how many trials in a row haven't raised the best by ``least_gain``, and ``stopped``, true from where a
    run that waits ``patience_`` trials would have ended. For one sequence of trials, which one task holds."""
    order_all = Window.partitionBy(F.lit(0)).orderBy(order)
    before = F.max(value).over(order_all.rowsBetween(Window.unboundedPreceding, -1))
    raised = F.when(before.isNull() | (F.col(value) > before + least_gain), 1).otherwise(0)
    marked = trials.withColumn("_raised", raised)
    marked = marked.withColumn("_island", F.sum("_raised").over(order_all.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("_island").orderBy(order)
    marked = marked.withColumn("stale", F.row_number().over(island) - 1)
    stop = F.max(F.when(F.col("stale") >= patience_, 1).otherwise(0)).over(order_all.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("stopped", stop == 1).drop("_raised", "_island")
