"""The same or nearly the same records in different splits, by content-defined chunks.

Each record becomes normalised text, field by field. A rolling hash of the text cuts it to chunks where its value says so,
and at the ends of fields. Within a run, records meet by the digests of single chunks: the leading ones of the sheet, of its
signature (digits in order, letters, year) and of the city, for records that differ in all three share too little. A digest in
many records is joined together with the place, so it isn't dropped and doesn't pair everything with everything. The lengths
of all chunks that two records share sum to the part of each that the other covers; pairs that share too little go, the rest
is checked field by field. Linked records form classes: two records describe the same thing also if only a third shows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.keys import clean, fold, number, tile_key
from gridwright.operators.components import connected_components
from gridwright.operators.skew import join_hot
from gridwright.operators.splits import boxes_within_groups
from gridwright.session import cut_lineage

#: Characters in the rolling window, mean length of a chunk, characters a chunk has at least (but for the end of a field).
WINDOW, MEAN_CHUNK, LEAST_CHUNK = 4, 8, 3
#: Distinct records with a digest up to which it is joined alone.
HOT = 64
#: Metres: bounds that differ less are the same up to typing; a moved sheet is within MOVED of its place.
NEAR, MOVED = 100.0, 5000.0
#: The part of the shorter of two records that shared chunks cover at least. The least that fits the check is a sheet number
#: of three digits in a record of 56 characters beside one that lacks its city.
LEAST_SHARE = 0.05
#: Fields of the text whose leading chunk is joined: sheet, signature, city.
JOINED_FIELDS = 3
#: Kilometres looked around for the nearest record of another split at first, and how that grows while none is found.
FIRST_RADIUS_KM, RADIUS_GROWTH, LAST_RADIUS_KM = 2.0, 5.0, 50_000.0
FIELD_END = "\x1f"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def chunk_batch(texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """``(offsets, digests, lengths)`` of the chunks of many texts at once; see :func:`chunks_with_fields`."""
    return chunks_with_fields(texts)[:3]


def chunks_with_fields(texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """``(offsets, digests, lengths, fields)`` of the chunks of many texts at once. Fields end with ``FIELD_END``.

    Prefix sums of ``code * base ** place`` give the hash of any stretch, so the rolling hash and the digests are computed
    for all characters of the batch by a few array operations. A digest depends on a chunk's text and field only.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    n = len(codes)
    if n == 0:
        return [0] * (len(texts) + 1), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, dtype=np.uint64)]), dtype=np.uint64)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, dtype=np.uint64)]), dtype=np.uint64)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        text_start = np.repeat(ends - sizes, sizes)
        separator = codes == ord(FIELD_END)
        before = np.concatenate([[0], np.cumsum(separator)])
        field = before[:-1] - before[text_start]
        field_start = np.maximum.accumulate(np.where(np.concatenate([[True], separator[:-1]]) | (np.arange(n) == text_start), np.arange(n), 0))
        place = np.arange(n)
        low = np.maximum(place - WINDOW + 1, field_start)
        rolling = _mix((prefix[1:] - prefix[low]) * back[low])
        cut = (rolling % np.uint64(MEAN_CHUNK) == 0) & (place - field_start + 1 >= LEAST_CHUNK)
        last_of_field = np.concatenate([separator[1:], [True]]) | (np.arange(n) == ends.repeat(sizes) - 1)
        cut = (cut | last_of_field) & ~separator
        stop = np.flatnonzero(cut) + 1
        owner = np.searchsorted(ends, stop - 1, side="right")
        start = np.concatenate([[0], stop[:-1]])
        start = np.maximum(start, field_start[stop - 1])
        digest = _mix(_mix((prefix[stop] - prefix[start]) * back[start]) + field[stop - 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (stop - start).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    return offsets.tolist(), digest.view(np.int64), (stop - start).astype(np.int32), field[stop - 1].astype(np.int32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def add_chunks(df: DataFrame, text: str) -> DataFrame:
    """Add ``digests``, ``lengths`` and ``fields`` (from 0), arrays with one entry for each chunk of ``text``; empty for null
    and empty texts."""
    kinds = {"digests": T.LongType(), "lengths": T.IntegerType(), "fields": T.IntegerType()}
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()]])
    at, columns = df.columns.index(text), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, *found = chunks_with_fields([t or "" for t in batch.column(at).to_pylist()])
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)) for values in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*columns, *kinds])

    return df.mapInArrow(run, schema)


def normalised(records: DataFrame) -> DataFrame:
    """Records with their split, sheet, edition, place and bounds in one spelling, missing ones filled from the long name.
    Bounds without an upper left corner count as none."""
    split = F.lower(F.trim("split_name"))
    split = F.when(split.isin("val", "valid", "validation", "dev"), "val").when(split.isin("test", "testing"), "test").when(split.isin("train", "training"), "train")
    long = r"^(?i:kdr)[\s_\-]*[0-9OoIiLl]{1,3}[A-Za-z]{0,4}[_\s\-]+(.*?)(?:[_\s\-]+(?:ca)?([0-9]{4}))?$"
    city = F.coalesce(clean(F.col("city")), clean(F.replace(F.regexp_extract("longname", long, 1), F.lit("_"), F.lit(" "))))
    year = F.coalesce(F.when(F.col("year") > 0, F.col("year").cast("int")), F.regexp_extract("longname", long, 2).try_cast("int"))
    key = F.coalesce(tile_key(F.col("shortname")), tile_key(F.col("longname")))
    placed = ~(F.isnan(F.coalesce("ul_x", F.lit(float("nan")))) | F.isnan(F.coalesce("ul_y", F.lit(float("nan")))))
    return records.where(F.col("record_id").isNotNull()).select(
        "record_id", "run_id", split.alias("split"), "source", key.alias("key"), fold(city).alias("city"), year.alias("year"), *[F.when(placed, number(F.col(c))).alias(c) for c in ("ul_x", "ul_y", "lr_x", "lr_y")],
    )


def record_text(at_metres: int = 100) -> Column:
    """The normalised record as text: sheet, its digits in order with the edition, city, year and rounded bounds."""
    digits = F.array_join(F.array_sort(F.split(F.regexp_extract("key", "([0-9]+)", 1), "")), "")
    letters = F.regexp_extract("key", "[0-9]+([A-Z]*)$", 1)
    rounded = [F.coalesce(F.round(F.col(c) / at_metres).cast("bigint").cast("string"), F.lit("")) for c in ("ul_x", "ul_y", "lr_x", "lr_y")]
    signature = F.concat(digits, letters, F.lit("/"), F.coalesce(F.col("year").cast("string"), F.lit("")))
    # what all sheets' keys begin with says nothing
    parts = [F.coalesce(F.replace(F.col("key"), F.lit("KDR_"), F.lit("")), F.lit("")), F.coalesce(signature, F.lit("")), F.coalesce("city", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), *rounded]
    return F.concat_ws(FIELD_END, *parts)


def same_edition(a: str, b: str) -> Column:
    """Whether two normalised records describe the same edition of the same sheet.

    The same key, a city that doesn't contradict, and: the same year (or none) at places not far apart, or a year mistyped
    by one or by swapped digits at the same place. Or the same letters, year and place, and a number with two neighbouring
    digits swapped. Or the same city, year and place (all there), and a number that lacks one of the other's digits, or no
    readable number on one side or both. Another digit means another sheet.
    """
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    gap = F.greatest(*[F.abs(x(c) - y(c)) for c in ("ul_x", "ul_y", "lr_x", "lr_y")])
    gap = F.when(x("ul_x").isNotNull() & y("ul_x").isNotNull(), gap)
    same_city = F.coalesce(x("city") == y("city"), F.lit(True))
    same_year = F.coalesce(x("year") == y("year"), F.lit(True))
    typed_year = (F.abs(x("year") - y("year")) <= 1) | (x("year_digits") == y("year_digits"))
    here = F.coalesce(gap <= NEAR, F.lit(False))
    not_far = F.coalesce(gap <= MOVED, F.lit(True))
    by_key = (x("key") == y("key")) & ((same_year & not_far) | (typed_year & gap.isNull()) | here)
    by_swap = (x("key") != y("key")) & x("swaps").contains(F.concat(y("key"), F.lit(" "))) & same_year & here
    known = (x("city") == y("city")) & (x("year") == y("year")) & here
    shorter = lambda p, q: p("dropped").contains(F.concat(q("key"), F.lit(" ")))
    by_rest = known & (x("key").isNull() | y("key").isNull() | ((x("key") != y("key")) & (shorter(x, y) | shorter(y, x))))
    return F.coalesce(same_city & (by_key | by_swap), F.lit(False)) | F.coalesce(by_rest, F.lit(False))


def with_swaps(nodes: DataFrame) -> DataFrame:
    """Add what the check needs: the keys with two neighbouring digits swapped, those with a digit missing, and the digits of
    the year in order."""
    p, q, r, rest = (F.substring("key", k, n) for k, n in ((5, 1), (6, 1), (7, 1), (8, 10)))
    swaps = F.concat_ws(" ", F.concat(F.lit("KDR_"), q, p, r, rest), F.concat(F.lit("KDR_"), p, r, q, rest), F.lit(""))
    dropped = F.concat_ws(" ", *[F.concat(F.lit("KDR_0"), a, b, rest) for a, b in ((q, r), (p, r), (p, q))], F.lit(""))
    return nodes.withColumn("swaps", swaps).withColumn("dropped", dropped).withColumn("year_digits", F.array_join(F.array_sort(F.split(F.col("year").cast("string"), "")), ""))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``.

    members: the normalised records with ``run_id, class_id``, the smallest record_id of those that describe the same.
    links: ``a, b, shared, share_a, share_b`` between representatives of exact copies that passed the check, with
    the characters in shared chunks and the part of each record they cover.

    Exact copies (equal in all normalised fields) are one node, so a third of all rows being copies of one record costs one
    row. A record without a key, or with one that lacks a digit, goes with the key of the nearest record it so matches, so it
    doesn't link two sheets; records without a run match only exact copies of themselves; null ids are left out.
    """
    fields = ["run_id", "key", "city", "year", "ul_x", "ul_y", "lr_x", "lr_y"]
    rows = normalised(records)
    rows = cut_lineage(rows.withColumn("same", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in fields])))
    # a 64-bit digest of the fields stands for them; the run, kept beside it, parts the rare records whose digests collide
    known = rows.groupBy("run_id", "same").agg(F.min("record_id").alias("node"), F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in fields if c != "run_id"])
    nodes = with_swaps(known.where("run_id is not null").withColumn("text", record_text()))
    nodes = add_chunks(nodes.select("run_id", "node", *fields[1:], "swaps", "dropped", "year_digits", "text"), "text")
    nodes = cut_lineage(nodes)
    packed = F.struct("node", "key", "city", "year", "ul_x", "ul_y", "lr_x", "lr_y", "swaps", "dropped", "year_digits").alias("r")
    # the leading chunk of a field: equal fields have it in common, and it is never shorter than a sheet number
    leading = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(JOINED_FIELDS - 1)), lambda f: F.try_element_at("digests", F.nullif(F.array_position("fields", f), F.lit(0)).cast("int"))))
    anchors = nodes.select("run_id", F.explode(leading).alias("digest"), packed)
    often = cut_lineage(anchors.groupBy("run_id", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).drop("n"))
    none_hot = often.isEmpty()
    cool = anchors if none_hot else anchors.join(often, ["run_id", "digest"], "left_anti")
    pairs = cool.alias("l").join(cool.alias("m"), (F.col("l.run_id") == F.col("m.run_id")) & (F.col("l.digest") == F.col("m.digest")) & (F.col("l.r.node") < F.col("m.r.node")))
    pairs = pairs.select(F.col("l.r").alias("x"), F.col("m.r").alias("y"))
    if not none_hot:
        # A hot digest counts together with the place: who matches and has bounds is in the same square or one of the eight
        # around it. Who has none is tied to whole groups instead of to each of their records.
        hot = anchors.join(often, ["run_id", "digest"], "left_semi")
        square = lambda c: F.floor(F.col(f"r.{c}") / MOVED).cast("bigint")
        steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        placed = hot.where("r.ul_x is not null")
        visits = placed.select("run_id", "digest", "r", F.xxhash64(square("ul_x"), square("ul_y")).alias("second"))
        hosts = placed.select("run_id", "digest", "r", F.explode(F.array(*[F.xxhash64(square("ul_x") + i, square("ul_y") + j) for i, j in steps])).alias("second"))
        hot_pairs = visits.alias("l").join(hosts.alias("m"), (F.col("l.run_id") == F.col("m.run_id")) & (F.col("l.digest") == F.col("m.digest")) & (F.col("l.second") == F.col("m.second")) & (F.col("l.r.node") < F.col("m.r.node")))
        pairs = pairs.union(hot_pairs.select(F.col("l.r").alias("x"), F.col("m.r").alias("y")))
    pairs = pairs.where(same_edition("x", "y"))
    gap = F.greatest(*[F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) for c in ("ul_x", "ul_y", "lr_x", "lr_y")])
    is_in = lambda key, kind, side: F.coalesce(F.col(f"{side}.{kind}").contains(F.concat(F.col(f"{key}.key"), F.lit(" "))), F.lit(False))
    weak = lambda p, q: F.col(f"{p}.key").isNull() | (F.coalesce(F.col("x.key") != F.col("y.key"), F.lit(False)) & is_in(p, "dropped", q) & ~is_in(p, "swaps", q))
    links = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"), weak("x", "y").alias("weak_a"), weak("y", "x").alias("weak_b"), gap.alias("gap"))
    if not none_hot:
        links = links.union(_without_place(hot, packed))
    links = _shared(cut_lineage(links.dropDuplicates(["a", "b"])), nodes).where(F.greatest("share_a", "share_b") >= LEAST_SHARE)
    links = _without_bridges(cut_lineage(links)).select("a", "b", "shared", "share_a", "share_b")
    found = connected_components(links, "a", "b")
    rooted = known.select("run_id", "same", "node", "_rows").join(found, "node", "left").select("run_id", "same", "node", "_rows", F.coalesce("component", "node").alias("class_id"))
    # a null run is no key of a join: its records get one of their own
    run = F.coalesce(F.struct("run_id").cast("string"), F.lit(""))
    rooted, keyed = (df.withColumn("_run", run) for df in (rooted, rows))
    members = join_hot(keyed, rooted.select("_run", "same", "node", "class_id"), ["_run", "same"], "record_id", sizes=rooted.select("_run", "same", "_rows"))
    members = members.select("record_id", "run_id", "split", "source", "node", "class_id", "key", "ul_x", "ul_y", "lr_x", "lr_y")
    return members, links


def _without_place(hot: DataFrame, packed: Column) -> DataFrame:
    """Links of records without bounds to all records of their sheet that fit, for sheets whose digest is hot.

    Such a record fits a record of the same sheet by city and year alone, so it fits whole groups of records with one city
    and year. It is linked to the least record of each such group, and each record of the group to the least such record:
    these are links between records that match, and they connect what all pairs would.
    """
    both = hot.select("run_id", "r").where("r.key is not null").dropDuplicates(["run_id", "r"])
    groups = both.groupBy("run_id", "r.key", "r.city", "r.year").agg(F.min_by("r", "r.node").alias("g"))
    lost = both.where("r.ul_x is null").select("run_id", F.col("r.key").alias("key"), F.col("r").alias("x"))
    # the group as a record without bounds, so that the check looks at city and year only
    plain = groups.select("run_id", "key", "g", F.struct("g.node", "g.key", "g.city", "g.year", *[F.lit(None).cast("double").alias(c) for c in ("ul_x", "ul_y", "lr_x", "lr_y")], "g.swaps", "g.dropped", "g.year_digits").alias("y"))
    met = lost.join(plain, ["run_id", "key"]).where(same_edition("x", "y"))
    one = met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), "key")
    least = met.groupBy("run_id", "key", F.col("y.city").alias("city"), F.col("y.year").alias("year")).agg(F.min("x.node").alias("u"))
    least = least.select(F.struct("run_id", "key", "city", "year").alias("of"), "u")
    many = both.select(F.struct("run_id", F.col("r.key").alias("key"), F.col("r.city").alias("city"), F.col("r.year").alias("year")).alias("of"), F.col("r.node").alias("v")).join(least, "of").select("u", "v", F.col("of.key").alias("key"))
    # nulls of city and year are equal inside a struct, so the groups meet theirs
    out = one.union(many).where("u <> v")
    return out.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(False).alias("weak_a"), F.lit(False).alias("weak_b"), F.lit(None).cast("double").alias("gap"))


def _shared(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` with ``shared``, the characters in shared chunks, and ``share_a`` and ``share_b``, the parts these cover."""
    sides = [nodes.select(F.col("node").alias(k), F.col("digests").alias(f"_digests_{k}"), F.col("lengths").alias(f"_lengths_{k}")) for k in ("a", "b")]
    shared = F.aggregate(F.filter(F.arrays_zip("_digests_a", "_lengths_a"), lambda c: F.array_contains("_digests_b", c["_digests_a"])), F.lit(0), lambda s, c: s + c["_lengths_a"])
    total = lambda k: F.greatest(F.lit(1), F.aggregate(f"_lengths_{k}", F.lit(0), lambda s, n: s + n))
    both = links.join(sides[0], "a").join(sides[1], "b")
    return both.select(*links.columns, shared.alias("shared"), (shared / total("a")).alias("share_a"), F.least(F.lit(1.0), shared / total("b")).alias("share_b"))


def _without_bridges(links: DataFrame) -> DataFrame:
    """Links (``a, b, key_a, key_b, weak_a, weak_b, gap``) without those of a weak node, whose key is missing or lacks a digit, to
    nodes of another key than its nearest's."""
    one = links.where("weak_a <> weak_b")
    if one.isEmpty():
        return links
    near = one.select(F.when(F.col("weak_a"), F.col("a")).otherwise(F.col("b")).alias("node"), F.when(F.col("weak_a"), F.col("key_b")).otherwise(F.col("key_a")).alias("key"), "gap")
    near = near.groupBy("node").agg(F.min_by("key", F.struct("gap", "key")).alias("near"))
    for k in ("a", "b"):
        links = links.join(near.select(F.col("node").alias(k), F.col("near").alias(f"near_{k}")), k, "left")
    fits = F.when(F.expr("weak_a and weak_b"), F.coalesce(F.expr("near_a = near_b"), F.lit(True))).when(F.col("weak_a"), F.expr("near_a = key_b")).when(F.col("weak_b"), F.expr("near_b = key_a")).otherwise(True)
    return cut_lineage(links.where(fits))


def cross_split_pairs(members: DataFrame) -> DataFrame:
    """``(record_a, record_b, ...)``, smaller id first: each train record with each val or test record of its class and run.

    The train records of a class with very many are dealt out and its held-out ones copied to each part.
    """
    left = members.where("split = 'train' and run_id is not null").select("run_id", "class_id", F.col("record_id").alias("train_id"), F.col("node").alias("train_node"))
    right = members.where("split in ('val', 'test') and run_id is not null").select("run_id", "class_id", F.col("record_id").alias("held_id"), "split", "source", F.col("node").alias("held_node"))
    met = join_hot(left, right, ["run_id", "class_id"], "train_id")
    return met.select("run_id", F.least("train_id", "held_id").alias("record_a"), F.greatest("train_id", "held_id").alias("record_b"), "train_id", "held_id", "split", "source", "train_node", "held_node")


def overlap_counts(members: DataFrame) -> DataFrame:
    """``run_id, pairs_found, held_out_found``: cross-split pairs and held-out records in them, without making the pairs."""
    ids = members.where("run_id is not null").select("run_id", "class_id", "record_id", F.when(F.col("split") == "train", "train").when(F.col("split").isin("val", "test"), "held").alias("side"))
    classes_ = ids.where("side is not null").distinct().groupBy("run_id", "class_id").agg(F.count_if(F.col("side") == "train").alias("n"), F.count_if(F.col("side") == "held").alias("m"))
    return classes_.groupBy("run_id").agg(F.sum(F.col("n") * F.col("m")).alias("pairs_found"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("held_out_found"))


PAIR_TYPES = ("train_val", "train_test", "val_test")


def split_minima(records: DataFrame, audits: DataFrame) -> DataFrame:
    """``run_id, min_train_val_km, min_train_test_km, min_val_test_km, near_pairs`` for each run of ``audits``.

    Distances of the records' rectangles, whatever they describe; near_pairs counts the pairs of different splits less than
    the run's ``d_leak_km`` apart. Equal rectangles of a split are one with a count. A minimum is looked for within a
    radius that grows for the runs that haven't found one, so it is exact and no run is compared all with all. Null where a
    split has no record with four bounds; a null d_leak_km counts as 0.
    """
    rows = normalised(records).where("run_id is not null and split is not null and ul_x is not null and lr_x is not null and lr_y is not null")
    boxes = rows.groupBy("run_id", "split", F.col("ul_x").alias("minx"), F.col("lr_x").alias("maxx"), F.col("lr_y").alias("miny"), F.col("ul_y").alias("maxy")).agg(F.min("record_id").alias("id"), F.count(F.lit(1)).alias("n"))
    boxes = cut_lineage(boxes.join(audits.select("run_id", F.coalesce("d_leak_km", F.lit(0.0)).alias("leak_km")), "run_id"))
    there = boxes.groupBy("run_id").agg(F.collect_set("split").alias("splits"))  # three at most
    both = F.array_compact(F.array(*[F.when(F.array_contains("splits", x) & F.array_contains("splits", y), f"{x}_{y}") for x, y in (t.split("_") for t in PAIR_TYPES)]))
    wanted = there.select("run_id", F.explode(both).alias("kind"))
    side = lambda k: boxes.select(F.col("id").alias(k), F.col("split").alias(f"split_{k}"), F.col("n").alias(f"n_{k}"), *(["leak_km"] if k == "a" else []))
    radius, found = FIRST_RADIUS_KM, None
    looked = boxes.withColumn("radius", F.greatest(F.lit(radius), "leak_km"))
    while True:
        near = boxes_within_groups(looked, "id", "run_id", "radius").join(side("a"), "a").join(side("b"), "b").where("split_a <> split_b")
        kind = F.when(F.array_contains(F.array("split_a", "split_b"), "train"), F.when(F.array_contains(F.array("split_a", "split_b"), "val"), "train_val").otherwise("train_test")).otherwise("val_test")
        leaks = F.coalesce(F.sum(F.when(F.col("edge_km") < F.col("leak_km"), F.col("n_a") * F.col("n_b"))), F.lit(0))
        part = near.groupBy("run_id", kind.alias("kind")).agg(F.min("edge_km").alias("km"), (leaks if found is None else F.lit(0).cast("long")).alias("leaks"))
        found = cut_lineage(part if found is None else found.union(part.join(found, ["run_id", "kind"], "left_anti")))
        left = wanted.join(found, ["run_id", "kind"], "left_anti").select("run_id").distinct()
        if radius >= LAST_RADIUS_KM or left.isEmpty():
            break
        radius = min(radius * RADIUS_GROWTH, LAST_RADIUS_KM)
        looked = boxes.join(left, "run_id", "left_semi").withColumn("radius", F.lit(radius))
    minima = found.groupBy("run_id").agg(*[F.min(F.when(F.col("kind") == t, F.col("km"))).alias(f"min_{t}_km") for t in PAIR_TYPES], F.sum("leaks").alias("near_pairs"))
    return audits.select("run_id").join(minima, "run_id", "left").na.fill(0, ["near_pairs"])


def overlap_report(members: DataFrame, links: DataFrame) -> DataFrame:
    """``run_id, split, source, records, overlapping, exact, mean_share``: what of each held-out split and source is in train.

    overlapping counts records of a class with a train record, exact those with an exact copy in train, mean_share is the
    mean part of an overlapping record that chunks shared with some linked record cover (1 for exact copies).
    """
    held = members.where("split in ('val', 'test') and run_id is not null")
    in_train = members.where("split = 'train'")
    by_class = in_train.select("class_id", F.lit(True).alias("met")).distinct()
    by_node = in_train.select("node", F.lit(True).alias("copy")).distinct()
    best = links.select(F.col("a").alias("node"), F.col("share_a").alias("share")).union(links.select("b", "share_b")).groupBy("node").agg(F.max("share").alias("share"))
    rows = held.join(by_class, "class_id", "left").join(by_node, "node", "left").join(best, "node", "left")
    share = F.when(F.col("copy"), 1.0).when(F.col("met"), F.col("share"))
    return rows.groupBy("run_id", "split", "source").agg(F.count(F.lit(1)).alias("records"), F.count_if("met").alias("overlapping"), F.count_if("copy").alias("exact"), F.avg(share).alias("mean_share"))
