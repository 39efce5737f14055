from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import grouped_splits, overlap

SCHEMA = "record_id long, run_id long, split_name string, source string, shortname string, longname string, city string, year int, ul_x double, ul_y double, lr_x double, lr_y double, key string, text string, node int"


def record(i, split, name="KDR_118", city="Au an der Wölpe", year=1901, x=1_000_000.0, run=1, long=None, source="s"):
    box = (x, 6_800_000.0, None if x is None else x + 9000.0, 6_790_000.0) if x is not None else (None,) * 4
    return (i, run, split, source, name, long, city, year, *box, "", "", 0)


def pairs_of(spark, rows):
    members, links = overlap.classes(spark.createDataFrame(rows, SCHEMA))
    return {(r.record_a, r.record_b) for r in overlap.cross_split_pairs(members).collect()}, members, links


def test_spellings_typing_errors_and_other_editions(spark):
    rows = [
        record(1, "train"), record(2, " VAL"), record(3, "test", "kdr-118.png", "AU  a. d. wölpe", x=None), record(4, "validation", "KDR_181", x=1_000_005.0),  # digits swapped
        record(5, "test", "KDR_118Z", year=1880), record(6, "test", year=1910, x=1_000_009.0), record(7, "test", city="Berg", year=1899, x=2_000_000.0), record(8, "test", x=1_001_500.0),
        record(9, "val", None, long="KDR-118_Au_an_der_Wölpe_1901", city=None, year=None), record(10, "val", run=2), record(11, "test", "KDR_119", x=1_000_005.0), record(12, "val", None, city=None, year=None),
        record(13, None), record(None, "val"), record(14, "val", run=None),
    ]
    got, members, links = pairs_of(spark, rows)
    assert got == {(1, k) for k in (2, 3, 4, 6, 8, 9)}
    assert members.count() == 14 and links.where("share_a > 1 or share_a < 0").count() == 0
    report = {r.split: (r.records, r.overlapping) for r in overlap.overlap_report(members, links).where("run_id = 1").collect()}
    assert report == {"val": (4, 3), "test": (6, 3)}


def test_seen_through_a_third_record(spark):
    rows = [record(1, "train", x=1_000_000.0), record(2, "train", x=1_004_000.0), record(3, "val", x=1_008_000.0)]
    assert pairs_of(spark, rows)[0] == {(1, 3), (2, 3)}


def brute(rows):
    """All pairs, for records with full fields in one spelling."""

    def same(a, b):
        gap = max(abs(a[k] - b[k]) for k in range(8, 12)) if a[8] is not None and b[8] is not None else None
        if a[6] != b[6]:
            return False
        typed = abs(a[7] - b[7]) <= 1 or sorted(str(a[7])) == sorted(str(b[7]))
        if a[4] == b[4]:
            return (a[7] == b[7] and (gap is None or gap <= 5000)) or (typed and gap is None) or (gap is not None and gap <= 100)
        p, q = a[4][4:7], b[4][4:7]
        swapped = q in (p[1] + p[0] + p[2], p[0] + p[2] + p[1])
        return swapped and a[4][7:] == b[4][7:] and a[7] == b[7] and gap is not None and gap <= 100

    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and same(a, b):
                parent[find(a[0])] = find(b[0])
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[1] == b[1] and a[2] == "train" and b[2] != "train" and find(a[0]) == find(b[0])}


@pytest.mark.parametrize("hot", [64, 3])
def test_against_all_pairs_with_hot_digests(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT", hot)
    rnd = random.Random(hot)
    rows = []
    for i in range(170):
        x = rnd.choice([1e6, 1e6 + 30, 1e6 + 3000, 1e6 + 6000, 2e6, None])
        rows.append(record(i, rnd.choice(["train", "train", "val", "test"]), rnd.choice(["KDR_118", "KDR_181", "KDR_118A", "KDR_119"]), rnd.choice(["Au", "Berg"]), rnd.choice([1901, 1902, 1910, 1880]), x, rnd.choice([1, 2])))
    assert pairs_of(spark, rows)[0] == brute(rows)


@pytest.mark.parametrize("hot", [64, 1])
def test_same_city_year_and_place_without_the_right_number(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT", hot)
    rows = [
        record(1, "train"), record(2, "val", "KDR_18", x=1_000_020.0), record(3, "test", "KDR_1118"), record(4, "val", "sheet", x=1_000_040.0), record(5, "test", "KDR_11", x=1_000_001.0),  # a digit missing, one too many, none
        *[record(10 * k, "train", run=k) for k in range(2, 9)], record(21, "val", "KDR_128", run=2), record(31, "val", "KDR_18A", run=3), record(41, "val", "KDR_18", year=1902, run=4), record(51, "val", "sheet", year=1902, run=5),
        record(61, "val", "sheet", city="Berg", run=6), record(71, "val", "sheet", x=1_003_000.0, run=7), record(81, "val", "sheet", x=None, run=8), record(91, "test", "KDR_1118", run=9),
    ]
    got, _, links = pairs_of(spark, rows)
    assert got == {(1, k) for k in (2, 3, 4, 5)}
    assert links.where("share_a > 1 or share_a <= 0 or share_b > 1 or share_b <= 0").count() == 0 < links.count()
    # a record without number, or with one that lacks a digit, doesn't link two sheets, but goes with the nearer
    rows = [record(1, "train"), record(2, "val", "KDR_118A", x=1_000_060.0), record(3, "test", "sheet", x=1_000_020.0), record(4, "train", "sheet", x=1_000_050.0)]
    rows += [record(5, "train", run=2), record(6, "train", "KDR_128", x=1_000_060.0, run=2), record(7, "val", "KDR_18", x=1_000_040.0, run=2)]
    assert pairs_of(spark, rows)[0] == {(1, 3), (2, 4), (6, 7)}


def test_minima_of_runs_near_and_far(spark):
    rows = [
        record(1, "train"), record(2, "Val", x=1_009_400.0), record(3, "test", x=1_500_000.0), record(4, "test", x=1_500_000.0), record(5, "val", x=None),  # 0.4 km, 491 km
        record(6, "train", run=2), record(7, "training", x=1_000_001.0, run=2), record(8, "test", x=9_000_000.0, run=2), record(9, "val", run=3), record(10, "odd", run=3), record(11, "train", run=None),
    ]
    audits = spark.createDataFrame([(1, 0.5), (2, None), (3, 1.0), (4, 1.0)], "run_id long, d_leak_km double")
    got = {r.run_id: (r.min_train_val_km, r.min_train_test_km, r.min_val_test_km, r.near_pairs) for r in overlap.split_minima(spark.createDataFrame(rows, SCHEMA), audits).collect()}
    assert got[1] == pytest.approx((0.4, 491.0, 481.6, 1)) and got[2] == (None, pytest.approx(7990.999), None, 0)
    assert got[3] == got[4] == (None, None, None, 0)
    assert overlap.split_minima(spark.createDataFrame([], SCHEMA), audits).count() == 4
    members, _ = overlap.classes(spark.createDataFrame(rows, SCHEMA).where("record_id is not null"))
    pairs = overlap.cross_split_pairs(members)
    counts = {r.run_id: (r.pairs_found, r.held_out_found) for r in overlap.overlap_counts(members).collect()}
    assert sum(n for n, _ in counts.values()) == pairs.count() and sum(m for _, m in counts.values()) == pairs.select("held_id").distinct().count()


def test_records_without_place_on_a_hot_sheet(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 2)
    rows = [record(i, "train" if i % 2 else "val", x=1_000_000.0 + 9_000 * i, year=1901 + i % 2) for i in range(12)]
    rows += [record(50, "test", x=None, year=1901), record(51, "val", x=None, year=None, city=None), record(52, "train", x=None, year=1955), record(53, "test", x=None, city="Berg")]
    assert pairs_of(spark, rows)[0] == brute_null(rows)


def brute_null(rows):
    """Pairs of the rows above: those without place tie all records of the sheet with their city and nearly their year."""
    tied = [r for r in rows if r[0] not in (52, 53)]
    tied += [r for r in rows if r[0] == 52]  # it fits the record without city and year
    tied += [r for r in rows if r[0] == 53]  # and so does another city
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in tied for b in tied if a[2] == "train" and b[2] != "train"}


def test_overlap_of_nothing(spark):
    members, links = overlap.classes(spark.createDataFrame([], SCHEMA))
    assert members.count() == links.count() == overlap.overlap_report(members, links).count() == 0


def test_chunks_follow_content():
    texts = ["", "abc\x1f" + "Raethlitzbruegg am Quast" * 4, "\x1f", "zz" * 3 + "Raethlitzbruegg am Quast" * 4, "x" * 100_000]
    offsets, digests, lengths = overlap.chunk_batch(texts)
    sums = [int(lengths[a:b].sum()) for a, b in zip(offsets, offsets[1:])]
    assert sums == [0, 3 + 96, 0, 102, 100_000]
    a, b = (set(digests[offsets[k] : offsets[k + 1]].tolist()) for k in (1, 3))
    other = overlap.chunk_batch(["abc\x1f" + "Raethlitzbruegg am Quast" * 4 + "!"])[1].tolist()
    assert len(a & set(other)) >= len(a) - 2 and not a & b  # the field is part of a digest
    one = overlap.chunk_batch([texts[3]])[1]
    assert np.array_equal(one, digests[offsets[3] : offsets[4]])
    assert overlap.chunk_batch([])[0] == [0]


PATCHES = "patch_key long, tile_shortname string, image_path string, split_fold int, component string, part string, entity string"


def test_groups_by_sheet_and_image(spark):
    rows = [(1, "KDR_001", "data/images/KDR_001.png", 1), (2, " kdr_001.PNG", None, None), (3, None, "C:\\x\\kdr_001.PNG", 2), (4, "KDR_002", "./KDR_003.png", 4), (5, "KDR_003", "/srv/KDR_003.png", 4), (6, "KDR_004", None, None), (7, None, None, 1), (8, None, "nan", 5), (9, "KDR_005", None, 1), (9, "KDR_005", None, 1), (None, "KDR_001", None, 5), (10, "KDR_006", "odd name.tif", 1), (11, "KDR_007", "b/ODD NAME.png", 3)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], PATCHES)
    items, groups, table = grouped_splits.assign(grouped_splits.patch_entities(df), grouped_splits.FOLD_PARTS)
    part = {r.item: (r.component, r.part) for r in items.collect()}
    assert items.count() == 12 and len({part[k][0] for k in (1, 2, 3)}) == 1 and part[4][0] == part[5][0] and part[10][0] == part[11][0]
    assert {r.first_item for r in groups.where("state = 'quarantine'").collect()} == {1, 10}
    assert part[1][1] == "quarantine" and part[4][1] == "val" and part[8][1] == "test" and part[6][1] in grouped_splits.PARTS
    assert groups.agg(F.sum("items")).first()[0] == 12
    more = spark.createDataFrame([(20, "KDR_002", "KDR_004.png", 5, "", "", ""), (21, "KDR_004", "KDR_004.png", None, "", "", "")], PATCHES)
    again, groups2, table2 = grouped_splits.assign(grouped_splits.patch_entities(df.union(more)), grouped_splits.FOLD_PARTS, before=table)
    assert {r.first_item for r in groups2.where("state = 'quarantine'").collect()} == {1, 4, 10}
    fresh = grouped_splits.component_table(grouped_splits.patch_entities(df.union(more)))
    assert set(map(tuple, table2.collect())) == set(map(tuple, fresh.collect()))


def test_new_groups_fill_what_is_lacking(spark):
    rows = [(i, f"KDR_{i // 4:03d}", None, 1 if i < 40 else None, "", "", "") for i in range(400)]
    df = spark.createDataFrame(rows, PATCHES)
    items, groups, _ = grouped_splits.assign(grouped_splits.patch_entities(df), grouped_splits.FOLD_PARTS)
    sizes = {r.part: r.n for r in items.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(sizes["train"] - 240) <= 8 and abs(sizes["val"] - 80) <= 8 and abs(sizes["test"] - 80) <= 8
    assert items.groupBy("component").agg(F.count_distinct("part").alias("p")).where("p > 1").count() == 0
    empty = grouped_splits.assign(grouped_splits.patch_entities(df.limit(0)), grouped_splits.FOLD_PARTS)
    assert [x.count() for x in empty] == [0, 0, 0]


def test_old_parts_hold_without_their_old_items(spark):
    rows = [(i, f"KDR_{i // 4:03d}", f"KDR_{i // 4:03d}.png", 1 if i < 40 else None, "", "", "") for i in range(400)]
    first = grouped_splits.assign(grouped_splits.patch_entities(spark.createDataFrame(rows, PATCHES)), grouped_splits.FOLD_PARTS)
    was = {r.item: r.part for r in first[0].collect()}
    sheets = {p: sorted({i // 4 for i in was if was[i] == p and i >= 40}) for p in grouped_splits.PARTS}
    train, val, test = (sheets[p] for p in grouped_splits.PARTS)
    # new patches only: of drawn sheets, of a new sheet, linking sheets of two parts and of one, and with a fold against the draw
    new = [(1000 + k, f"KDR_{k:03d}", None, None) for k in (val[0], test[0], train[0])] + [(2000 + i, "KDR_900", None, None) for i in range(40)]
    new += [(3001, f"KDR_{train[1]:03d}", f"KDR_{val[1]:03d}.png", None), (3002, f"KDR_{test[1]:03d}", f"KDR_{test[2]:03d}.png", None), (3003, f"KDR_{val[2]:03d}", None, 1), (3004, f"KDR_{val[3]:03d}", None, 4)]
    # an item of the first call comes again
    new += [(val[0] * 4, f"KDR_{val[0]:03d}", None, None), (test[3] * 4, None, None, None)]
    batch = spark.createDataFrame([(*r, "", "", "") for r in new], PATCHES)
    again = grouped_splits.assign(grouped_splits.patch_entities(batch), grouped_splits.FOLD_PARTS, earlier=first)
    now = {r.item: r.part for r in again[0].collect()}
    assert again[0].count() == len(now) == 400 + 47
    out = {4 * k + i for k in (train[1], val[1], val[2]) for i in range(4)}
    assert {i: now[i] for i in was if i not in out} == {i: was[i] for i in was if i not in out}
    assert {now[i] for i in (*out, 3001, 3003)} == {"quarantine"}
    assert (now[1000 + val[0]], now[1000 + test[0]], now[1000 + train[0]], now[3002], now[3004]) == ("val", "test", "train", "test", "val")
    assert again[1].agg(F.sum("items")).first()[0] == 447 and len({now[i] for i in range(2000, 2040)}) == 1
    third = grouped_splits.assign(grouped_splits.patch_entities(batch.limit(0)), grouped_splits.FOLD_PARTS, earlier=again)
    assert {r.item: r.part for r in third[0].collect()} == now


def test_a_batch_of_new_items_alone_through_written_tables(spark, tmp_path):
    rows = [(i, f"KDR_{i // 4:03d}", f"KDR_{i // 4:03d}.png", 5 if i < 16 else None, "", "", "") for i in range(120)]
    first = grouped_splits.assign(grouped_splits.patch_entities(spark.createDataFrame(rows, PATCHES)), grouped_splits.FOLD_PARTS)
    grouped_splits.save(first, str(tmp_path / "state"))
    was = {r.component: r.part for r in grouped_splits.load(spark, str(tmp_path / "state"))[1].collect()}
    batch = spark.createDataFrame([(1000 + k, f"KDR_{k:03d}", None, None, "", "", "") for k in range(30)], PATCHES)
    items, groups, table = grouped_splits.assign(grouped_splits.patch_entities(batch), grouped_splits.FOLD_PARTS, earlier=grouped_splits.load(spark, str(tmp_path / "state")))
    assert {r.component: r.part for r in groups.collect()} == was
    assert {r.component for r in items.where("item >= 1000").collect()} == set(was) and items.count() == 150
    assert all(r.part == "test" for r in items.where("item between 1000 and 1003").collect())
    assert table.count() == 60
    # names of components hold but where a lesser entity joins
    more = spark.createDataFrame([(2000, "KDR_003", "KDR_000.png", None, "", "", "")], PATCHES)
    merged = grouped_splits.component_table(grouped_splits.patch_entities(more), table)
    assert {r.component for r in merged.where("entity like '%KDR_00%' and entity not like '%KDR_000%'").collect()} >= {"image:KDR_000"}
    assert merged.where("entity = 'tile:KDR_003'").first().component == "image:KDR_000" and merged.count() == 60


def test_old_items_count_in_what_is_lacking(spark):
    first = grouped_splits.assign(grouped_splits.patch_entities(spark.createDataFrame([(i, f"KDR_{i // 4:03d}", None, 1, "", "", "") for i in range(120)], PATCHES)), grouped_splits.FOLD_PARTS)
    batch = spark.createDataFrame([(i, f"KDR_{i // 4:03d}", None, None, "", "", "") for i in range(400, 480)], PATCHES)
    items, _, _ = grouped_splits.assign(grouped_splits.patch_entities(batch), grouped_splits.FOLD_PARTS, earlier=first)
    sizes = {r.part: r.n for r in items.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes["train"] == 120 and abs(sizes["val"] - 40) <= 4 and abs(sizes["test"] - 40) <= 4
