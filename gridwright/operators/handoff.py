"""Checks before data is handed on: agreement of manifest and rows, completeness, policy, presence; and queues of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The exit codes by the first kind of rule that is broken.
EXIT_CODES = {"schema": 2, "policy": 4, "data": 3}
#: Relative places in a tile where patches are cut, in the order they are used; more are cut at the middle.
ANCHORS = ((0.33, 0.33), (0.67, 0.67), (0.33, 0.67), (0.67, 0.33), (0.50, 0.50), (0.20, 0.20), (0.80, 0.80), (0.20, 0.80), (0.80, 0.20))


def default_anchors(number: int) -> list[tuple[float, float]]:
    """The first ``number`` anchors."""
    return [ANCHORS[k] if k < len(ANCHORS) else (0.5, 0.5) for k in range(number)]


def parse_anchors(text: Column) -> Column:
    """``x,y;x,y`` as an array of structs ``x, y``; null unless all are pairs of numbers from 0 to 1 and there is one at least."""
    tokens = F.filter(F.transform(F.split(text, ";"), lambda t: F.trim(t)), lambda t: t != "")
    number = lambda t, k: F.trim(F.try_element_at(F.split(t, ","), F.lit(k))).try_cast("double")
    parsed = F.transform(tokens, lambda t: F.struct(number(t, 1).alias("x"), number(t, 2).alias("y"), F.size(F.split(t, ",")).alias("n")))
    good = F.forall(parsed, lambda p: (p["n"] == 2) & F.coalesce(p["x"].between(0, 1) & p["y"].between(0, 1), F.lit(False)))
    return F.when(good & (F.size(parsed) > 0), F.transform(parsed, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def excluded_but_selected(selected: DataFrame, exclusions: list[DataFrame], key: str) -> DataFrame:
    """``key`` of what is selected though one of the lists excludes it, once each."""
    out = exclusions[0].select(key)
    for more in exclusions[1:]:
        out = out.union(more.select(key))
    return selected.select(key).where(F.col(key).isNotNull()).distinct().join(out, key, "left_semi")


def missing_requirements(selected: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """``key`` of what is selected but isn't there."""
    return selected.select(key).where(F.col(key).isNotNull()).distinct().join(there.select(key), key, "left_anti")


def list_digest(rows: DataFrame, by: str, item: str) -> DataFrame:
    """``by, items, digest``: how many different items each group has and a digest that doesn't depend on their order.

    The items' own digests are summed, so no task holds a group's list.
    """
    one = F.conv(F.substring(F.sha2(F.col(item).cast("string"), 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return rows.where(F.col(item).isNotNull()).select(by, item).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.sum(one).cast("string").alias("digest"))


def disagreement(told: DataFrame, found: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``key, status`` and both sides' ``values`` where two tables differ: only_told, only_found or different."""
    side = lambda df, s: df.select(F.col(key).alias(f"_k{s}"), *[F.col(v).alias(f"{v}{s}") for v in values])
    both = side(told, "_told").join(side(found, "_found"), F.col("_k_told") == F.col("_k_found"), "full")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"{v}_told").eqNullSafe(F.col(f"{v}_found"))
    status = F.when(F.col("_k_found").isNull(), "only_told").when(F.col("_k_told").isNull(), "only_found").when(differs, "different")
    return both.select(F.coalesce("_k_told", "_k_found").alias(key), status.alias("status"), *[f"{v}{s}" for v in values for s in ("_told", "_found")]).where("status is not null")


def verdict(violations: DataFrame) -> DataFrame:
    """One row from ``kind`` of each violation: counts by kind and the exit code, of schema before policy before data."""
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_violations") for k in EXIT_CODES]
    code = F.lit(0)
    for kind in reversed(EXIT_CODES):
        code = F.when(F.col(f"{kind}_violations") > 0, EXIT_CODES[kind]).otherwise(code)
    return violations.agg(*counts).withColumn("exit_code", code)


def queue(open_tasks: DataFrame, group: str, task: str, deferred: Column, priority: Column) -> DataFrame:
    """Add ``place`` from 0 in each group's queue: the priority first, then the regular tasks, the deferred last; by task within."""
    turn = F.when(F.coalesce(priority, F.lit(False)), 0).when(F.coalesce(deferred, F.lit(False)), 2).otherwise(1)
    return open_tasks.withColumn("_turn", turn).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_turn", task)) - 1).drop("_turn")


def undo_last(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` without the last of each group by ``order``; rows with a null group stay."""
    last = rows.groupBy(group).agg(F.max(order).alias("_last"))
    return rows.join(last, group, "left").where(F.col("_last").isNull() | (F.col(order) < F.col("_last"))).drop("_last")
