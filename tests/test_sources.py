from __future__ import annotations

import struct

import pytest

from gridwright.operators import contract
from gridwright.sources import readers, sinks
from gridwright.streaming import monitor


def test_csv_by_other_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,C,254;x\n", encoding="utf-8")
    path = tmp_path / "b.csv"
    path.write_text("longName;shortName;left;top;right;bottom;Jahr;city\nKDR_001_Ort_1901;;1,5;10;2,5;8;;n/a\nKDR_002;KDR_002;x;1;2;3;1917;Au\n", encoding="utf-8")
    rows = readers.standardise(readers.read_text_table(spark, str(path), ";")).collect()
    assert (rows[0].sheet, rows[0].year, rows[0].center_x, rows[0].city) == ("KDR_001", 1901, 2.0, None)
    assert (rows[1].ul_x, rows[1].year, rows[1].city) == (None, 1917, "Au")
    (tmp_path / "c.csv").write_text("tile_id,year\n1,2\n")
    with pytest.raises(ValueError):
        readers.standardise(readers.read_text_table(spark, str(tmp_path / "c.csv")))


def test_dbase(spark, tmp_path):
    fields, rows = [("NAME", 8), ("ORT", 10)], [("KDR_001", "Wölpe"), ("KDR_002", ""), ("KDR_003", "Au")]
    head = struct.pack("<4BIHH20x", 3, 25, 1, 1, len(rows), 32 + 32 * len(fields) + 1, 1 + sum(w for _, w in fields))
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r"
    body = b"".join((b"*" if k == 2 else b" ") + b"".join(v.encode("latin-1").ljust(w) for v, (_, w) in zip(r, fields)) for k, r in enumerate(rows))
    (tmp_path / "t.dbf").write_bytes(head + body)
    readers.register(spark)
    got = spark.read.format("dbase3").option("recordsPerPartition", "2").load(str(tmp_path / "t.dbf")).collect()
    assert [(r.NAME, r.ORT) for r in got] == [("KDR_001", "Wölpe"), ("KDR_002", None)]


def test_images_and_sidecars(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\0" * 16
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 300, 200) + b"\0" * 10
    (tmp_path / "KDR_001.png").write_bytes(png)
    (tmp_path / "kdr_002a.jpg").write_bytes(jpeg)
    (tmp_path / "KDR_003.png").write_bytes(b"no image")
    (tmp_path / "KDR_001.png.aux.xml").write_text('<PAMDataset><SRS>PROJCS["x",AUTHORITY["EPSG","3857"]]</SRS><GeoTransform> 100.0, 2.0, 0, 500.0, 0, -2.0</GeoTransform></PAMDataset>')
    images = readers.scan_images(spark, str(tmp_path))
    got = {r.sheet: (r.width_px, r.height_px) for r in images.collect()}
    assert got == {"KDR_001": (640, 480), "KDR_002A": (200, 300), "KDR_003": (None, None)}
    rows = {r.sheet: (r.epsg, r.lr_x, r.lr_y, r.data_quality) for r in readers.with_extent(readers.read_sidecars(spark, str(tmp_path)), images).collect()}
    assert rows["KDR_001"] == (3857, 1380.0, -460.0, "ok") and rows["KDR_003"][3] == "unknown"


def test_json_yaml_trials_lists(spark, tmp_path):
    for k, text in enumerate(['{"run_id": "a", "report": "x", "finished_at": "2026-01-01T00:00:00"}', '{"run_id": "b", "finished_at": "2026-02-01T00:00:00"}', "no json"]):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "run.json").write_text(text)
    assert readers.newest_run(spark, str(tmp_path)).first().run_id == "a"
    (tmp_path / "p.yaml").write_text("rules: [{id: a}]\n")
    assert readers.read_policy(str(tmp_path / "p.yaml")) == {"rules": [{"id": "a"}]}
    (tmp_path / "t.csv").write_text("Number,objective_value,params_a,extra\n1,0.5,0.25,z\n2,,x,z\n")
    rows = readers.read_trials(spark, str(tmp_path / "t.csv")).collect()
    assert (rows[0].number, rows[0].value, rows[0].alpha, rows[0].beta) == (1, 0.5, 0.25, None) and rows[1].alpha is None
    kinds = {r.column: (r.kind, r.low, r.choices) for r in readers.column_distributions(readers.read_trials(spark, str(tmp_path / "t.csv"))).collect()}
    assert kinds["number"] == ("int", 1.0, None) and kinds["value"][0] == "float" and kinds["state"][0] == "categorical"
    (tmp_path / "l.txt").write_text("# a\np1\n\n p2 \np1\n")
    assert {r.item for r in readers.allow_list(spark, str(tmp_path / "l.txt")).collect()} == {"p1", "p2"}
    assert readers.synthetic_candidates(spark, 5, 1).collect() == readers.synthetic_candidates(spark, 5, 1).collect()


def test_write_once(spark, tmp_path):
    df, meta = spark.range(3), {"a": 1}
    first = sinks.write_once(df, str(tmp_path), meta)
    assert sinks.write_once(df, str(tmp_path), meta) == first and sinks.read_cache(spark, str(tmp_path), meta).count() == 3
    assert sinks.read_cache(spark, str(tmp_path), meta, "write_only") is None and sinks.read_cache(spark, str(tmp_path), {"a": 2}) is None
    (tmp_path / (first.split("/")[-1] + ".json")).unlink()
    with pytest.raises(sinks.CacheConflict):
        sinks.write_once(df, str(tmp_path), meta)


def test_files_and_manifests(spark, tmp_path):
    target = tmp_path / "x.csv"
    assert sinks.replace_atomically(str(target), "1") is None and sinks.replace_atomically(str(target), "2") is not None and target.read_text() == "2"
    rows = {r.path: (r.exists, r.bytes) for r in sinks.file_manifest(spark, [str(target), str(tmp_path / "no")]).collect()}
    assert rows == {str(target): (True, 1), str(tmp_path / "no"): (False, None)}
    body = sinks.split_manifest(spark.createDataFrame([("train", 2), ("train", 1), ("val", 3)], "split string, row_id int"), str(tmp_path / "m.json"), {"version": 1})
    assert body["splits"] == {"train": [1, 2], "val": [3]} and sinks.digest({k: v for k, v in body.items() if k != "manifest_sha256"}) == body["manifest_sha256"]
    assert sinks.markdown_table(spark.range(1)).splitlines()[-1] == "| 0 |"
    sinks.append_results(spark.createDataFrame([(1, 0.5), (2, None)], "n int, v double"), str(tmp_path / "res"))
    sinks.append_results(spark.createDataFrame([(3, 0.9)], "n int, v double"), str(tmp_path / "res"))
    assert sinks.best_results(spark, str(tmp_path / "res"), "v").first().n == 3


def test_contracts(spark, tmp_path):
    source = tmp_path / "s"
    source.write_text("1")
    snap = contract.snapshot({"k": 1}, {"k": {"method": "auto:x"}}, [str(source)])
    assert contract.check_snapshot(snap) == []
    source.write_text("2")
    assert len(contract.check_snapshot(snap)) == 1 and len(contract.check_snapshot({**snap, "parameters": {"k": 2}})) == 3
    assert contract.check_contract(snap, {"k": {"methods": ["auto:*"]}, "z": {}, "y": {"required": False}}) == ["z is missing"]
    assert contract.resolve("n", ("a", None), ("b", 3)) == (3, "b")
    with pytest.raises(ValueError):
        contract.resolve("n", ("a", None))
    df = spark.range(50)
    assert contract.row_basis_digest(df, ["id"]).first() == contract.row_basis_digest(df.repartition(5), ["id"]).first()


def test_stream_gives_the_figures_of_a_batch(spark, tmp_path):
    rows = [(i, f"2026-01-0{1 + i // 4} 0{i % 4}:00:00", 1, "a" if i % 2 else "b", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").selectExpr("event_id", "timestamp(ts) ts", "user_id", "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = monitor.write_windows(monitor.windowed_best(monitor.read_trials(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(str(r.window_start)[:10], r.event_type, r.trials, r.best) for r in got} >= {("2026-01-01", "b", 2, 2.0), ("2026-01-02", "a", 2, 7.0)}
