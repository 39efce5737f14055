"""Exclusion and reporting rules, compiled from a mapping (as read from YAML) to column expressions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def lookup(constants: dict[str, Any], path: str) -> Any:
    """The value at a dotted path, or None."""
    at: Any = constants
    for part in path.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    return at


def compile_rule(match: dict[str, Any], constants: dict[str, Any], columns: list[str]) -> Column:
    """All conditions of a rule together. Nulls never match; a missing column or constant makes the rule match nothing.

    short_name: one of a list, case aside. long_name_contains: any of the patterns (regular expressions). year_lt, year_lte,
    year_gt, year_gte: a number, or year_..._ref: a dotted path to a constant.
    """
    checks: list[Column] = []
    for key, wanted in match.items():
        values = wanted if isinstance(wanted, list) else [wanted]
        if key == "short_name":
            checks.append(F.lower(F.trim("short_name")).isin([str(v).strip().lower() for v in values]) if "short_name" in columns else F.lit(False))
        elif key == "long_name_contains":
            checks.append(reduce(lambda a, b: a | b, [F.col("long_name").rlike(f"(?i){v}") for v in values]) if "long_name" in columns and values else F.lit(False))
        elif key.startswith("year_"):
            operator = key.removeprefix("year_").removesuffix("_ref")
            bound = lookup(constants, str(wanted)) if key.endswith("_ref") else wanted
            known = operator in COMPARISONS and "year" in columns and isinstance(bound, (int, float))
            checks.append(F.expr(f"year {COMPARISONS[operator]} {bound}") if known else F.lit(False))
        else:
            raise ValueError(f"unknown condition {key}")
    if not checks:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks])


def apply_policy(df: DataFrame, policy: dict[str, Any], key: str) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, flags)``: rows that no excluding rule matches, and ``key, rule_id, action, rationale`` for each match of
    a reporting rule among them. One pass for each result; no rules keep all rows and flag none."""
    constants, rules = policy.get("constants", {}), policy.get("rules", [])
    compiled = [(r, compile_rule(r.get("match", {}), constants, df.columns)) for r in rules]
    out = [c for r, c in compiled if r.get("action") == "exclude_from_candidate_pool"]
    kept = df.where(~reduce(lambda a, b: a | b, out)) if out else df
    reports = [F.when(c, F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["action"]).alias("action"), F.lit(r.get("rationale")).alias("rationale"))) for r, c in compiled if r.get("action") == "flag_for_reporting"]
    if not reports:
        reports = [F.lit(None).cast("struct<rule_id:string,action:string,rationale:string>")]
    flags = kept.select(key, F.explode(F.array_compact(F.array(*reports))).alias("f")).select(key, "f.*")
    return kept, flags
