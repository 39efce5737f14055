"""Sinks: ranked selections, write-once caches, atomic replacement, append buffers, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no blanks, so equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_selection(selection: DataFrame, path: str) -> None:
    """A selection in the order of its rank, as one CSV file; selections are small."""
    selection.orderBy("selection_rank").coalesce(1).write.mode("overwrite").csv(path, header=True)


class CacheConflict(RuntimeError):
    """The cache holds something else, or a part of it, under this name."""


def write_once(df: DataFrame, folder: str, meta: dict[str, Any]) -> str:
    """Write a table under the digest of ``meta``, once. Equal meta again is a no-op; a table without its meta, or with
    other, is an error. The table appears by a rename, so readers never see a part of it."""
    key = digest(meta)
    target = Path(folder) / f"hash={key}"
    side = target.with_name(target.name + ".json")
    if target.exists() or side.exists():
        if not (target.exists() and side.exists()):
            raise CacheConflict(f"{target} is incomplete")
        if side.read_text() != canonical_json(meta):
            raise CacheConflict(f"{target} was written for other parameters")
        return str(target)
    Path(folder).mkdir(parents=True, exist_ok=True)
    draft = Path(folder) / f".draft-{uuid.uuid4().hex}"
    df.write.parquet(str(draft))
    side.write_text(canonical_json(meta))
    try:
        os.rename(draft, target)
    except OSError as error:  # another writer was faster
        shutil.rmtree(draft, ignore_errors=True)
        if not target.exists():
            raise CacheConflict(str(error)) from error
    return str(target)


def read_cache(spark: SparkSession, folder: str, meta: dict[str, Any], mode: str = "read_write") -> DataFrame | None:
    """The cached table of ``meta``, or None; mode off and write_only never read."""
    if mode not in ("off", "read_only", "write_only", "read_write"):
        raise ValueError(f"unknown cache mode {mode}")
    target = Path(folder) / f"hash={digest(meta)}"
    if mode in ("off", "write_only") or not target.exists():
        return None
    side = target.with_name(target.name + ".json")
    if not side.exists() or side.read_text() != canonical_json(meta):
        raise CacheConflict(f"{target} was written for other parameters")
    return spark.read.parquet(str(target))


def replace_atomically(path: str, content: str, keep: bool = True) -> str | None:
    """Put a new file in a file's place by a rename; the old one is kept beside it with a time stamp, whose path is returned."""
    target, backup = Path(path), None
    draft = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    draft.write_text(content, encoding="utf-8")
    if target.exists() and keep:
        backup = target.with_name(f"{target.stem}.{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}{target.suffix}")
        shutil.copy2(target, backup)
    os.replace(draft, target)
    return str(backup) if backup else None


def append_results(df: DataFrame, path: str) -> None:
    """Add rows to a table of results."""
    df.write.mode("append").parquet(path)


def best_results(spark: SparkSession, path: str, by: str, ascending: bool = False, n: int = 1) -> DataFrame:
    """The best rows of a table of results; nulls last."""
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return spark.read.parquet(path).orderBy(order).limit(n)


def buffer_stats(df: DataFrame, value: str) -> DataFrame:
    """``count, best (the smallest), mean`` of buffered results."""
    return df.agg(F.count(value).alias("count"), F.min(value).alias("best"), F.avg(value).alias("mean"))


def file_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, exists, bytes, sha256`` of files; missing ones are listed too."""
    there = [p for p in paths if Path(p).exists()]
    wanted = spark.createDataFrame([(p,) for p in paths], "path string") if paths else spark.createDataFrame([], "path string")
    if not there:
        return wanted.select("path", F.lit(False).alias("exists"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    files = spark.read.format("binaryFile").load(there)
    found = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(True).alias("exists"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return wanted.join(found, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def split_manifest(parts: DataFrame, path: str, extra: dict[str, Any]) -> dict[str, Any]:
    """Write ``split, ids`` rows (a small table) with facts about the split as JSON; its own digest is over the rest."""
    body = {**extra, "splits": {r["split"]: sorted(r["ids"]) for r in parts.groupBy("split").agg(F.collect_list("row_id").alias("ids")).collect()}}
    body["manifest_sha256"] = digest(body)
    replace_atomically(path, canonical_json(body), keep=False)
    return body


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
