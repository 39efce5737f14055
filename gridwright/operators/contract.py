"""Provenance: parameter snapshots, contracts and resolution, run records."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import platform
import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.sources.sinks import digest


def row_basis_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """``rows, digest`` of a table, whatever the order of its rows: the sum of row hashes, and their number."""
    h = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.coalesce(F.sum(h), F.lit(0)).cast("string"), 256).alias("digest"))


def snapshot(parameters: dict[str, Any], provenance: dict[str, dict[str, Any]], sources: list[str] = (), notes: str = "") -> dict[str, Any]:
    """Parameters with where each comes from, and digests of them and of the source files."""
    files = {s: hashlib.sha256(Path(s).read_bytes()).hexdigest() for s in sources}
    body = {"parameters": parameters, "provenance": provenance, "notes": notes, "source_files": files}
    return {**body, "hashes": {"parameters": digest(parameters), "content": digest(body)}}


def check_snapshot(snap: dict[str, Any]) -> list[str]:
    """What is wrong with a snapshot; nothing if it is as it was written and its files are unchanged."""
    wrong = []
    body = {k: snap.get(k) for k in ("parameters", "provenance", "notes", "source_files")}
    if digest(snap.get("parameters")) != snap.get("hashes", {}).get("parameters"):
        wrong.append("parameters differ from their digest")
    if digest(body) != snap.get("hashes", {}).get("content"):
        wrong.append("content differs from its digest")
    for name, want in (snap.get("source_files") or {}).items():
        if not Path(name).exists():
            wrong.append(f"{name} is missing")
        elif hashlib.sha256(Path(name).read_bytes()).hexdigest() != want:
            wrong.append(f"{name} has changed")
    wrong += [f"{p} has no provenance" for p in snap.get("parameters") or {} if p not in (snap.get("provenance") or {})]
    return wrong


def check_contract(snap: dict[str, Any], contract: dict[str, dict[str, Any]]) -> list[str]:
    """Parameters that a contract asks for: there, by an allowed method (patterns such as ``auto:*``), with evidence if wanted."""
    wrong = []
    for name, rule in contract.items():
        if name not in snap.get("parameters", {}):
            if rule.get("required", True):
                wrong.append(f"{name} is missing")
            continue
        source = snap.get("provenance", {}).get(name, {})
        method = str(source.get("method", ""))
        if rule.get("methods") and not any(fnmatch.fnmatch(method, m) for m in rule["methods"]):
            wrong.append(f"{name}: method {method or 'none'} isn't allowed")
        if rule.get("evidence") and not (source.get("evidence") and Path(source["evidence"]).exists()):
            wrong.append(f"{name}: no evidence file")
    return wrong


def resolve(name: str, *candidates: tuple[str, Any]) -> tuple[Any, str]:
    """The first value that isn't None, and the name of its source; an error if there is none."""
    for source, value in candidates:
        if value is not None:
            return value, source
    raise ValueError(f"{name}: no value from {', '.join(s for s, _ in candidates)}")


def run_record(run_id: str, parameters: dict[str, Any]) -> dict[str, Any]:
    return {"run_id": run_id, "started_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "host": platform.node(), "python": platform.python_version(), "pid": os.getpid(), "parameters_sha256": digest(parameters)}


def error_record(run_id: str, stage: str, error: BaseException) -> dict[str, Any]:
    return {"run_id": run_id, "stage": stage, "kind": type(error).__name__, "message": str(error)[:2000], "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
