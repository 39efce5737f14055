"""Leakage-safe spatial splits: distance graphs, assignment of components, calibration, audit, grouped folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.geo import edge_km
from gridwright.operators.components import connected_components
from gridwright.operators.pairs import box

PARTS = ("train", "val", "test")


def boxes_within(df: DataFrame, key: str, least_km: float, cell_km: float | None = None) -> DataFrame:
    """``a, b, edge_km`` for each pair of rectangles less than ``least_km`` apart, the smaller key first.

    A range join by grid: a rectangle is written to the cells it touches, the other, widened by the distance, to those it
    then touches; a pair is kept in the first cell they share. Rows need ``minx maxx miny maxy`` in metres; rows with nulls
    match nothing. Choose ``cell_km`` near the size of a rectangle plus the distance (that is the default, from the data's
    mean width).
    """
    rows = df.where(F.col(key).isNotNull() & (F.col("maxx") >= F.col("minx")) & (F.col("maxy") >= F.col("miny"))).select(key, "minx", "maxx", "miny", "maxy")
    if cell_km is None:
        mean = rows.agg(F.avg(F.col("maxx") - F.col("minx"))).first()[0] or 0.0
        cell_km = max(mean / 1000 + least_km, 0.001)
    cell = cell_km * 1000
    at = lambda c, add: F.floor((F.col(c) + add) / cell).cast("long")

    def placed(widen: float) -> DataFrame:
        x, y = F.sequence(at("minx", -widen), at("maxx", widen)), F.sequence(at("miny", -widen), at("maxy", widen))
        return rows.select("*", F.explode(x).alias("cx")).select("*", F.explode(y).alias("cy"))

    a = placed(least_km * 1000).select("cx", "cy", *[F.col(c).alias(f"{c}_a") for c in rows.columns])
    b = placed(0.0).select("cx", "cy", *[F.col(c).alias(f"{c}_b") for c in rows.columns])
    met = a.join(b, ["cx", "cy"]).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    wide = least_km * 1000
    first_x = F.floor(F.greatest(F.col("minx_a") - wide, F.col("minx_b")) / cell)
    first_y = F.floor(F.greatest(F.col("miny_a") - wide, F.col("miny_b")) / cell)
    met = met.where((F.col("cx") == first_x) & (F.col("cy") == first_y))
    return met.select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"), edge_km(box("_a"), box("_b")).alias("edge_km")).where(F.col("edge_km") < least_km)


def boxes_within_groups(df: DataFrame, key: str, group: str, radius_km: str, size_km: float = 10.0) -> DataFrame:
    """``group, a, b, edge_km`` for each two rectangles of a group less than the group's own ``radius_km`` apart, a < b.

    As :func:`boxes_within`, by an equi-join on group and grid cell; the cells of a group are as large as its radius and
    ``size_km``, about the size of a rectangle, so one group with a wide radius doesn't slow the others. Rows with nulls
    match nothing.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(group).isNotNull() & (F.col(radius_km) > 0) & (F.col("maxx") >= F.col("minx")) & (F.col("maxy") >= F.col("miny")))
    rows = rows.select(group, F.col(key).alias("id"), "minx", "maxx", "miny", "maxy", (F.col(radius_km) * 1000).alias("wide"), ((F.col(radius_km) + size_km) * 1000).alias("cell"))
    at = lambda c, add: F.floor((F.col(c) + add) / F.col("cell")).cast("long")

    def placed(widen) -> DataFrame:
        x, y = F.sequence(at("minx", -widen), at("maxx", widen)), F.sequence(at("miny", -widen), at("maxy", widen))
        return rows.select("*", F.explode(x).alias("cx")).select("*", F.explode(y).alias("cy"))

    a = placed(F.col("wide")).select(group, "cx", "cy", "wide", "cell", *[F.col(c).alias(f"{c}_a") for c in ("id", "minx", "maxx", "miny", "maxy")])
    b = placed(F.lit(0.0)).select(group, "cx", "cy", *[F.col(c).alias(f"{c}_b") for c in ("id", "minx", "maxx", "miny", "maxy")])
    met = a.join(b, [group, "cx", "cy"]).where("id_a < id_b")
    first = lambda low: F.floor(F.greatest(F.col(f"{low}_a") - F.col("wide"), F.col(f"{low}_b")) / F.col("cell"))
    met = met.where((F.col("cx") == first("minx")) & (F.col("cy") == first("miny"))).withColumn("edge_km", edge_km(box("_a"), box("_b")))
    return met.where(F.col("edge_km") * 1000 < F.col("wide")).select(group, F.col("id_a").alias("a"), F.col("id_b").alias("b"), "edge_km")


def spatial_components(df: DataFrame, key: str, least_km: float) -> DataFrame:
    """``key, component`` for all rows: rectangles linked by gaps under the distance; the component is its smallest key."""
    found = connected_components(boxes_within(df, key, least_km), "a", "b")
    return df.select(key).join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def quadrant(x: Column, y: Column, mid_x: Column, mid_y: Column) -> Column:
    return F.concat(F.when(y >= mid_y, "N").otherwise("S"), F.when(x >= mid_x, "E").otherwise("W"))


def year_bin(year: Column, edges: list[int]) -> Column:
    """``lo-hi`` for the half-open bin a year is in, nan outside, all if there are fewer than two edges."""
    if len(edges) < 2:
        return F.lit("all")
    out = F.lit("nan")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((year >= low) & (year < high), f"{low}-{high}").otherwise(out)
    return out


def component_facts(df: DataFrame, key: str, components: DataFrame, edges: list[int]) -> DataFrame:
    """``component, size, year_mode, region_mode``; the smallest of tied modes."""
    mid = df.agg(F.expr("percentile(center_x, 0.5)").alias("_x"), F.expr("percentile(center_y, 0.5)").alias("_y"))
    rows = df.crossJoin(F.broadcast(mid)).join(components, key)  # one row
    rows = rows.withColumn("_bin", year_bin(F.coalesce("year", F.lit(0)), edges)).withColumn("_region", quadrant(F.col("center_x"), F.col("center_y"), F.col("_x"), F.col("_y")))
    return rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.expr("mode(_bin, true)").alias("year_mode"), F.expr("mode(_region, true)").alias("region_mode"))


def assign_components(facts: DataFrame, shares: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """Add ``split`` to each component: the largest first, each to the part with the smallest score.

    The score is ten times the distance, in rows, of the part's size from its target, with the component in it, plus the
    rows it already has in components of the same year mode and of the same region; ties go to train, then val. By this rule
    small parts fill first, so many small components can leave train short of its share; for exact shares use
    prefix sums as in the grouped splits. The order matters, so this is one task, over components, not rows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "component"], ascending=[False, True], kind="stable")
        total = float(group["size"].sum())
        sizes, years, regions = [0.0] * 3, [{}, {}, {}], [{}, {}, {}]
        out = []
        for row in group.itertuples(index=False):
            score = [10 * abs(sizes[p] + row.size - shares[p] * total) + years[p].get(row.year_mode, 0) + regions[p].get(row.region_mode, 0) for p in range(3)]
            p = min(range(3), key=lambda q: (round(score[q], 9), q))
            sizes[p] += row.size
            years[p][row.year_mode] = years[p].get(row.year_mode, 0) + row.size
            regions[p][row.region_mode] = regions[p].get(row.region_mode, 0) + row.size
            out.append(PARTS[p])
        return group.drop(columns="_one").assign(split=out)

    kind = dict(facts.dtypes)["component"]
    return facts.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, f"component {kind}, size long, year_mode string, region_mode string, split string")


def binned_similarity(raw: DataFrame, km: str, similarity: str, width: float) -> DataFrame:
    """``bin_start_km, bin_end_km, n_pairs, mean_similarity, std_similarity`` (deviation of the population) of pairs."""
    k = F.floor(F.col(km) / width)
    rows = raw.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(similarity).alias("mean_similarity"), F.stddev_pop(similarity).alias("std_similarity"))
    return rows.select((F.col("k") * width).alias("bin_start_km"), ((F.col("k") + 1) * width).alias("bin_end_km"), "n_pairs", "mean_similarity", "std_similarity")


def calibrate(bins: DataFrame, raw: DataFrame, km: str, similarity: str, least: int = 5, stable: int = 2, epsilon: float = 0.01) -> DataFrame:
    """``d_leak_km``: the start of the first bin from which it and the next ``stable`` bins have enough pairs and a mean
    similarity no higher than that of the farthest quarter plus epsilon; else the lower quartile of the distances."""
    quarter = raw.agg(F.expr(f"percentile({km}, 0.75)").alias("far"), F.expr(f"percentile({km}, 0.25)").alias("near"))
    far = raw.crossJoin(F.broadcast(quarter)).where(F.col(km) >= F.col("far")).agg(F.avg(similarity).alias("level"))  # one row
    # the bins are few (the greatest distance over the width), so one task orders them
    following = Window.partitionBy(F.lit(0)).orderBy("bin_start_km").rowsBetween(0, stable)
    looked = bins.crossJoin(F.broadcast(far))
    looked = looked.withColumn("_max", F.max("mean_similarity").over(following)).withColumn("_min", F.min("n_pairs").over(following)).withColumn("_rows", F.count(F.lit(1)).over(following))
    good = looked.where((F.col("_max") <= F.col("level") + epsilon) & (F.col("_min") >= least) & (F.col("_rows") >= max(1, stable)))
    return good.agg(F.min("bin_start_km").alias("found")).crossJoin(quarter).select(F.coalesce("found", "near").alias("d_leak_km"), F.col("found").isNotNull().alias("calibrated"))


def leakage_audit(df: DataFrame, key: str, split: str, least_km: float) -> DataFrame:
    """``pair_type, violations, min_edge_km`` of rows of different splits less than the distance apart; none give no row."""
    near = boxes_within(df, key, least_km)
    part = df.select(key, split)
    both = near.join(part.select(F.col(key).alias("a"), F.col(split).alias("_a")), "a").join(part.select(F.col(key).alias("b"), F.col(split).alias("_b")), "b").where("_a <> _b")
    order = F.array_sort(F.array("_a", "_b"))
    return both.groupBy(F.array_join(order, "-").alias("pair_type")).agg(F.count(F.lit(1)).alias("violations"), F.min("edge_km").alias("min_edge_km"))


def grouped_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """``group, size, fold`` (from 1): groups by size, largest first and then by name, each to the fold with fewest rows.

    One task holds the groups, not the rows; equal loads go to the lowest fold.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "name"], ascending=[False, True], kind="stable")
        load, out = [0] * folds, []
        for size in rows["size"]:
            f = min(range(folds), key=lambda q: (load[q], q))
            load[f] += int(size)
            out.append(f + 1)
        return rows[["name", "size"]].assign(fold=out)

    sizes = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("name")).agg(F.count(F.lit(1)).alias("size"))
    found = sizes.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "name string, size long, fold int")
    return found.select(F.col("name").alias(group), "size", "fold")
