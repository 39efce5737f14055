"""Joins that spread hot keys, and only those, over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of all rows, and ``LEAST_ROWS`` rows at least; so there are at most
#: ``1 / HOT_SHARE`` hot keys, whatever the table's size, and they may be broadcast.
HOT_SHARE, LEAST_ROWS = 0.001, 20_000


def hot_keys(sizes: DataFrame, keys: list[str], rows: str) -> DataFrame | None:
    """``keys, _parts`` of the hot keys among ``sizes``, which has one row a key and its number of ``rows``; None if none is."""
    whole = sizes.agg(F.sum(rows).alias("all"), F.max(rows).alias("most")).first()
    least = max((whole["all"] or 0) * HOT_SHARE, LEAST_ROWS)
    if (whole["most"] or 0) <= least:
        return None
    return sizes.where(F.col(rows) > least).select(*keys, F.ceil(F.col(rows) / least).cast("int").alias("_parts"))


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner", sizes: DataFrame | None = None, rows: str = "_rows") -> DataFrame:
    """``big`` joined with ``small`` on ``keys``; the rows of a hot key of ``big`` are dealt out by a hash of ``spread``, and
    only the hot keys' rows of ``small`` are copied.

    ``how`` is inner or left. ``sizes`` has the rows of each key of ``big`` if they are known. Null keys match nothing and
    are dealt out too. Nothing else is copied, so a table without hot keys is joined as it is.
    """
    if sizes is None:
        sizes = big.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows))
    hot = hot_keys(sizes, keys, rows)
    if hot is None:
        return big.join(small, keys, how)
    dealt = big.join(F.broadcast(hot), keys, "left")
    null, number = F.lit(False), F.xxhash64(F.col(spread))
    for key in keys:
        null = null | F.col(key).isNull()
    part = F.when(null, -1 - F.pmod(number, F.lit(4096))).otherwise(F.pmod(number, F.coalesce("_parts", F.lit(1)).cast("long")))
    dealt = dealt.withColumn("_part", part.cast("int")).drop("_parts")
    copied = small.join(F.broadcast(hot), keys, "left")
    copied = copied.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")
