"""Ranks within groups of any size, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.session import cut_lineage


def hash_order(*keys: Column, seed: int = 0) -> Column:
    """A 64-bit number that orders rows at random but the same way in every run."""
    return F.xxhash64(F.lit(seed), *keys)


def rank_in_groups(df: DataFrame, groups: list[str], order: str, ties: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Add ``out``, the rank from 0 of each row in its group by ``order`` (a uniform 64-bit hash), then ``ties``.

    The rows of a group are cut into ``buckets`` by the value of ``order``, so a group with a third of all rows is ranked by
    that many tasks: ranks within buckets, plus the rows in earlier buckets, which are counted on the side. An empty table
    gives an empty table. Rows equal in order and ties get different ranks in no fixed order.
    """
    width = 2**64 // buckets
    df = df.withColumn("_bucket", F.floor((F.col(order).cast("double") + 2.0**63) / float(width)).cast("int"))
    df = df.withColumn("_bucket", F.least(F.greatest("_bucket", F.lit(0)), F.lit(buckets - 1)))
    sizes = df.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    same = [df[c].eqNullSafe(offsets[c]) for c in [*groups, "_bucket"]]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    within = Window.partitionBy(*groups, "_bucket").orderBy(order, *ties)
    ranked = df.withColumn("_within", F.row_number().over(within) - 1)
    joined = ranked.join(offsets, condition)
    return joined.select(*[ranked[c] for c in df.columns if c != "_bucket"], (F.col("_within") + F.col("_before")).alias(out))


def prefix_totals(df: DataFrame, order: str, ties: list[str], amount: str, out: str, buckets: int = 64) -> DataFrame:
    """Add ``out``, the sum of ``amount`` over the rows before each row by ``order`` (a 64-bit hash), then ``ties``; as above."""
    width = 2**64 // buckets
    df = df.withColumn("_bucket", F.floor((F.col(order).cast("double") + 2.0**63) / float(width)).cast("int"))
    df = df.withColumn("_bucket", F.least(F.greatest("_bucket", F.lit(0)), F.lit(buckets - 1)))
    sizes = df.groupBy("_bucket").agg(F.sum(amount).alias("_size"))
    # at most `buckets` rows reach the one task of this window
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = summed.join(offsets, "_bucket")
    return joined.select(*[c for c in df.columns if c != "_bucket"], (F.col("_within") + F.col("_before")).alias(out))


def dense_rank_all(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``, the place from 0 of each row of the whole table by ``order``, which should be a total order.

    The table is sorted by ranges, so each task ranks one range; the ranges' sizes, one row each, give the offsets.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # as many rows as there are partitions reach the one task of this window
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(*order)
    ranked = ranged.withColumn("_within", F.row_number().over(within) - 1).join(F.broadcast(offsets), "_range")
    return ranked.select(*df.columns, (F.col("_within") + F.col("_before")).alias(out))


def latest(df: DataFrame, key: str, by: list[Column | str]) -> DataFrame:
    """One row for each non-null ``key``: the last by ``by``, then by all other columns. Rows that arrive twice count once.

    Map-side partial aggregation keeps a hot key from crowding one task.
    """
    rest = [c for c in df.columns if c != key]
    sortable = [F.col(c) for c, kind in df.dtypes if c != key and not kind.startswith("map")]
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in by], *sortable)
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(key, *[F.col("_last")[c].alias(c) for c in rest])
