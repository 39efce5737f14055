"""Readers: metadata in CSV and dBase, side-cars, images, JSON, policies, trials. Schemas are declared, never inferred."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridwright.functions.keys import clean, decimal, tile_key

#: Canonical columns and the names they are known by, tried in this order, whole names before parts of names.
ALIASES = {
    "short_name": ("shortname", "short_name", "tile", "sheet"),
    "long_name": ("longname", "long_name", "title"),
    "city": ("city", "ort", "place"),
    "year": ("year", "jahr"),
    "ul_x": ("ul_x", "left", "minx", "xmin"),
    "ul_y": ("ul_y", "top", "maxy", "ymax"),
    "lr_x": ("lr_x", "right", "maxx", "xmax"),
    "lr_y": ("lr_y", "bottom", "miny", "ymin"),
    "image_path": ("image_path", "path", "filename"),
}
REQUIRED = ("long_name", "ul_x", "ul_y", "lr_x", "lr_y")
NUMBERS = ("ul_x", "ul_y", "lr_x", "lr_y", "year")


def map_headers(headers: list[str]) -> dict[str, str]:
    """``{canonical: header}``: names are compared without case, whole ones first, then as parts; each header is used once."""
    found: dict[str, str] = {}
    for whole in (True, False):
        for name, known in ALIASES.items():
            if name in found:
                continue
            for header in headers:
                low = header.strip().lower()
                if header not in found.values() and any(low == k if whole else k in low for k in known):
                    found[name] = header
                    break
    return found


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with all columns as text; the header gives the names, repaired where tools wrote ``name,C,254``."""
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    names = [h.strip().strip('"').split(",C,")[0] for h in first[0].lstrip("﻿").split(sep)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=False, enforceSchema=True)


def standardise(raw: DataFrame) -> DataFrame:
    """Text columns by any known name to the canonical ones, with centres worked out from the bounds.

    Numbers may have a decimal comma; what is no number is null. The first four digits in a row of the long name stand in
    for a missing year. Bounds and long name must be there as columns; other columns are dropped.
    """
    names = map_headers(raw.columns)
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    values = {c: (F.col(f"`{h}`") if c in names else F.lit(None).cast("string")) for c, h in {**dict.fromkeys(ALIASES), **names}.items()}
    df = raw.select(*[(decimal(v) if c in NUMBERS else clean(v)).alias(c) for c, v in values.items()])
    year = F.coalesce(F.when(F.col("year") != 0, F.col("year")).cast("int"), F.regexp_extract("long_name", r"([0-9]{4})", 1).try_cast("int"))
    df = df.withColumn("year", year).withColumn("sheet", F.coalesce(tile_key(F.col("short_name")), tile_key(F.col("long_name"))))
    return df.withColumn("center_x", (F.col("ul_x") + F.col("lr_x")) / 2).withColumn("center_y", (F.col("ul_y") + F.col("lr_y")) / 2)


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each non-null key."""
    return df.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")


class DBaseSource(DataSource):
    """dBase III tables as a Spark source: ``spark.read.format("dbase3").load(path)``; all columns text.

    The fixed record length lets a file be cut to ranges of records that tasks read on their own.
    """

    @classmethod
    def name(cls) -> str:
        return "dbase3"

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n, _ in dbase_header(self.options["path"])[2])

    def reader(self, schema: Any) -> DataSourceReader:
        return _DBaseReader(self.options["path"], self.options.get("encoding"), int(self.options.get("recordsperpartition", 100_000)))


def dbase_header(path: str) -> tuple[int, int, list[tuple[str, int]], int]:
    """``(records, bytes of header, [(name, width)], bytes of a record)``"""
    with open(path, "rb") as f:
        head = f.read(32)
        records, header, record = struct.unpack("<IHH", head[4:12])
        fields = []
        while True:
            d = f.read(32)
            if not d or d[0] in (0x0D, 0x00):
                break
            fields.append((d[:11].split(b"\0")[0].decode("ascii", "replace"), d[16]))
    return records, header, fields, record


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _DBaseReader(DataSourceReader):
    def __init__(self, path: str, encoding: str | None, step: int):
        self.path, self.encoding, self.step = path, encoding, step

    def partitions(self) -> list[InputPartition]:
        records = dbase_header(self.path)[0]
        return [_Range(a, min(records, a + self.step)) for a in range(0, max(records, 1), self.step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        _, header, fields, record = dbase_header(self.path)
        with open(self.path, "rb") as f:
            f.seek(header + partition.start * record)
            for _ in range(partition.stop - partition.start):
                row = f.read(record)
                if len(row) < record or row[:1] == b"*":  # cut off or deleted
                    continue
                at, values = 1, []
                for _, width in fields:
                    values.append(self._text(row[at : at + width]).strip() or None)
                    at += width
                yield tuple(values)

    def _text(self, raw: bytes) -> str:
        for encoding in [self.encoding] if self.encoding else ["utf-8", "latin-1"]:
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    spark.dataSource.register(DBaseSource)


def image_size(content: bytes) -> tuple[int, int] | None:
    """``(width, height)`` from the head of a PNG or JPEG file, without decoding it; None for others."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                return None
            kind, length = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            at += 2 + length
    return None


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, sheet, bytes, sha256, width_px, height_px`` of the PNG and JPEG files of a folder, sorted by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").option("recursiveFileLookup", "true").load(folder)

    @F.pandas_udf("width_px int, height_px int")
    def size(content: pd.Series) -> pd.DataFrame:
        found = [image_size(bytes(c)) or (None, None) for c in content]
        return pd.DataFrame(found, columns=["width_px", "height_px"]).astype("Int32")

    # headers are at the start; a quarter of a megabyte holds those of any camera or scanner
    out = files.select("path", tile_key(F.col("path")).alias("sheet"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), size(F.substring("content", 1, 262144)).alias("s"))
    return out.select("path", "sheet", "bytes", "sha256", "s.width_px", "s.height_px").orderBy("path")


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """``path, sheet, epsg, ul_x, ul_y, pixel_width, pixel_height`` of side-car XML files (GeoTransform and SRS)."""
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(folder)
    df = files.select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.split(F.trim(F.xpath_string("value", F.lit("//GeoTransform"))), r"\s*,\s*")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    srs = F.xpath_string("value", F.lit("//SRS"))
    epsg = F.coalesce(F.when(F.regexp_extract(srs, r'AUTHORITY\["EPSG","(\d+)"\]\]\s*$', 1) != "", F.regexp_extract(srs, r'AUTHORITY\["EPSG","(\d+)"\]\]\s*$', 1)), F.when(F.regexp_extract(srs, r"(?i)epsg:(\d+)", 1) != "", F.regexp_extract(srs, r"(?i)epsg:(\d+)", 1)))
    return df.select("path", tile_key(F.col("path")).alias("sheet"), epsg.cast("int").alias("epsg"), number(1).alias("ul_x"), number(4).alias("ul_y"), number(2).alias("pixel_width"), number(6).alias("pixel_height"))


def with_extent(sidecars: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``lr_x, lr_y, data_quality``: the far corner from the pixel sizes; ok, partial or unknown."""
    joined = images.join(sidecars.drop("path"), "sheet", "left")
    lr_x, lr_y = F.col("ul_x") + F.col("pixel_width") * F.col("width_px"), F.col("ul_y") + F.col("pixel_height") * F.col("height_px")
    known = [F.col(c).isNotNull().cast("int") for c in ("ul_x", "ul_y", "pixel_width", "pixel_height", "width_px", "height_px")]
    have = sum(known, F.lit(0))
    return joined.withColumn("lr_x", lr_x).withColumn("lr_y", lr_y).withColumn("data_quality", F.when(have == 6, "ok").when(have > 2, "partial").otherwise("unknown"))


def read_json_loose(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; fields that don't fit are null, files that are no JSON give a row of nulls."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc")).select("path", "doc.*")


def read_policy(path: str) -> dict[str, Any]:
    """A policy in YAML, read by the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """``number, value, state, alpha, beta, gamma, min_distance_km`` of trials, by any of the names that tools give them."""
    raw = read_text_table(spark, path)
    names = {"number": ("number", "trial", "trial_id"), "value": ("value", "objective_value", "score"), "state": ("state", "status"), "alpha": ("alpha", "params_a", "params_alpha"),
             "beta": ("beta", "params_b", "params_beta"), "gamma": ("gamma", "params_c", "params_gamma"), "min_distance_km": ("min_distance_km", "params_min_distance_km", "distance")}
    low = {c.lower(): c for c in raw.columns}
    pick = lambda known: F.coalesce(*[clean(F.col(f"`{low[k]}`")) for k in known if k in low], F.lit(None).cast("string"))
    kinds = {"number": "bigint", "state": "string"}
    return raw.select(*[(decimal(pick(k)) if c not in kinds else pick(k).try_cast(kinds[c])).alias(c) for c, k in names.items()])


def column_distributions(df: DataFrame) -> DataFrame:
    """``column, kind, low, high, choices`` of each column: int, float or categorical (up to 50 choices are listed)."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        numeric = kind in ("int", "bigint", "double", "float", "smallint", "tinyint")
        label = "int" if numeric and kind not in ("double", "float") else "float" if numeric else "categorical"
        low, high = (F.min(c).cast("double"), F.max(c).cast("double")) if numeric else (F.lit(None).cast("double"), F.lit(None).cast("double"))
        choices = F.lit(None).cast("array<string>") if numeric else F.slice(F.array_sort(F.collect_set(c.cast("string"))), 1, 50)
        parts.append(F.struct(F.lit(name).alias("column"), F.lit(label).alias("kind"), low.alias("low"), high.alias("high"), choices.alias("choices")))
    return df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("c")).select("c.*")


def synthetic_candidates(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` candidates at places and in years that follow from their number and the seed alone."""
    draw = lambda k: F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    df = spark.range(n).withColumnRenamed("id", "row_id")
    return df.withColumn("center_x", draw(1) * 200_000 + 450_000).withColumn("center_y", draw(2) * 300_000 + 5_800_000).withColumn("year", (draw(3) * 65).cast("int") + 1880)


def newest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run of a folder with a ``run.json`` (run_id, report, finished_at) each; runs with a report come first."""
    runs = read_json_loose(spark, f"{folder}/*/run.json", "run_id string, report string, finished_at string").where("run_id is not null")
    return runs.agg(F.max_by(F.struct("run_id", "path"), F.struct(F.col("report").isNotNull(), F.to_timestamp("finished_at"), "run_id")).alias("r")).select("r.*")


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """``item``: the lines of a file without blanks, comments and repeats."""
    lines = spark.read.text(path).select(F.trim("value").alias("item"))
    return lines.where("item <> '' and not startswith(item, '#')").distinct()
