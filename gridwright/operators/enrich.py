"""Filling fields of records from other tables, and checks of one table against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.keys import clean


def base_key(key: Column) -> Column:
    """A sheet key without its variant letters."""
    return F.regexp_replace(key, r"[A-Z]+$", "")


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a non-null key, the first by ``order``. The filter is pushed into the ranking, so hot keys stay small."""
    ranked = df.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_k = 1").drop("_k")


def fill_from(base: DataFrame, source: DataFrame, key: str, fields: list[str], order: list[Column]) -> DataFrame:
    """Left join on ``key``: a field of ``base`` that has a value stays, an empty one takes the source's."""
    src = first_per_key(source.select(key, *fields), key, order).select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = base.join(src, key, "left")
    return joined.select(*[(F.coalesce(clean(F.col(c)), F.col(f"_{c}")).alias(c) if c in fields else F.col(c)) for c in base.columns])


def fill_from_variant(base: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Like :func:`fill_from`, and what is still empty takes the values of the sheet without variant letters: its own record
    before those of other variants, records with a city before those without."""
    exact = fill_from(base, source, key, fields, [F.col(f).asc_nulls_last() for f in fields])
    ranked = source.withColumn("_base", base_key(F.col(key)))
    order = [(F.col(key) == F.col("_base")).desc(), clean(F.col(fields[0])).isNotNull().desc(), F.col(key)]
    src = first_per_key(ranked.select(key, "_base", *fields), "_base", order).select("_base", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = exact.withColumn("_base", base_key(F.col(key))).join(src, "_base", "left")
    return joined.select(*[(F.coalesce(clean(F.col(c)), F.col(f"_{c}")).alias(c) if c in fields else F.col(c)) for c in base.columns])


def override(base: DataFrame, source: DataFrame, key: str, field: str) -> DataFrame:
    """Left join on ``key``: a value of the source replaces the field."""
    src = source.where(clean(F.col(field)).isNotNull()).groupBy(key).agg(F.min(field).alias("_new"))
    return base.join(src, key, "left").withColumn(field, F.coalesce("_new", field)).drop("_new")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for each rule that a row breaks; a rule that is null for a row isn't broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def compare_trees(a: DataFrame, b: DataFrame, path: str, digest: str) -> DataFrame:
    """``path, status`` of two sets of files: same, different, only_a or only_b."""
    left, right = a.select(path, F.col(digest).alias("_a")), b.select(path, F.col(digest).alias("_b"))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("_a") == F.col("_b"), "same").otherwise("different")
    return left.join(right, path, "full").select(path, status.alias("status"))
