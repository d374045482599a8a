"""Readers and writers on files, and streams against their batch answers."""

import io
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileforge.jobs import catalog_queries
from tileforge.operators import batch
from tileforge.sources import files
from tileforge.streaming import scenes


def test_discover_and_lists(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/one.tiff", "a/b/two.tiff", "a/no.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "list").write_text(" p1 \n\np2\n")
    found = files.discover(spark, str(tmp_path))
    assert sorted(os.path.basename(r.path) for r in found.collect()) == ["one.tiff", "two.tiff"]
    assert sorted(r.path for r in files.image_paths(spark, file_list=str(tmp_path / "list")).collect()) == ["p1", "p2"]
    with pytest.raises(ValueError):
        files.image_paths(spark, files=["a"], directory="b")


def test_npy_elevation_and_bad_files(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(12.0).reshape(3, 4))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    (tmp_path / "N01E002.hgt").write_bytes(np.array([[1, -32768], [3, 4]], ">i2").tobytes())
    tiles = {r.scene_id: r for r in files.read_npy(spark, str(tmp_path), rows_per_tile=10).collect()}
    assert list(tiles["x"].data) == list(range(12)) and tiles["x"].n_bands == 1
    assert tiles["bad"].error
    bad = files.invalid_inputs(spark.createDataFrame([("d/e.npy", 0)], "path string, length long"), files.read_npy(spark, str(tmp_path)))
    assert {r.scene_id for r in bad.collect()} == {"e", "bad"}
    h = files.read_elevation(spark, str(tmp_path), side=2).first()
    assert h.data[0] == 1 and np.isnan(h.data[1])


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.txt", "hello")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("n.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "c.zip").write_bytes(b"broken")
    rows = files.unpack(spark, str(tmp_path)).collect()
    assert sorted((r.member, bytes(r.content)) for r in rows if r.error is None) == [("m.txt", b"hello"), ("n.txt", b"hi")]
    assert sum(r.error is not None for r in rows) == 1


def test_shapes_and_headers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('# WKT, region\n"POLYGON ((0 0, 4 0, 4 4, 0 0))",urban\n"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2)))"," urban, river"\n"POINT (1 1)",x\n')
    rows = files.read_shapes(spark, str(tmp_path / "s.csv")).orderBy("shape_id").collect()
    assert [list(r.tags) for r in rows] == [["urban"], ["urban", "river"]]
    assert [[(g.poly, g.hole, len(g.pts)) for g in r.rings] for r in rows] == [[(0, False, 4)], [(0, False, 4), (1, False, 4)]]
    (tmp_path / "scene7.txt").write_text("A = 1\nB = 2")
    assert tuple(files.read_headers(spark, str(tmp_path / "scene7.txt")).first()) == ("scene7", "A = 1\nB = 2")


def test_stream_picks_up_each_file_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    df = spark.range(10).select(F.col("id"))
    df.write.parquet(src)
    for n, more in ((10, None), (15, range(100, 105))):
        if more is not None:
            spark.createDataFrame([(i,) for i in more], "id long").write.mode("append").parquet(src)
        scenes.process_new(scenes.read_stream(spark, src, df.schema), out, check).awaitTermination()
        assert spark.read.parquet(out).count() == n


def test_block_side():
    assert files.block_side(5, 3) == 5 and files.block_side(300, 50) == 288 and files.block_side(5000, 10) == 1024


def test_archives_and_elevation_have_their_place(spark, tmp_path):
    (tmp_path / "in" / "a" / "b").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "in" / "a" / "b" / "one.zip", "w") as z:
        z.writestr("d/m.txt", "hello")
    members = files.unpacked_paths(files.unpack(spark, str(tmp_path / "in")), str(tmp_path / "in")).collect()
    assert [r.path for r in members] == ["a/b/one/d/m.txt"]
    (tmp_path / "N01W002.hgt").write_bytes(np.array([[1, -32768], [3, 4]], ">i2").tobytes())
    t = files.elevation_bounds(files.read_elevation(spark, str(tmp_path), side=2), side=2).first()
    assert tuple(t.bounds) == (-2, 1, -1, 2) and t.pixel_size == 1.0


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    """Over 2 GB, most of it a hole in a sparse file; rows beyond 2 GB come from their own range."""
    h, w = 9000, 30000
    with open(tmp_path / "big.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (h, w)})
        begin = f.tell()
        for y in (0, 8999):
            f.seek(begin + y * w * 8)
            f.write(np.arange(w, dtype="<f8").tobytes() if y == 0 else (np.arange(w, dtype="<f8") + y).tobytes())
    assert os.path.getsize(tmp_path / "big.npy") > 2 << 30
    (tmp_path / "cut.npy").write_bytes(b"\x93NUMPY\x01\x00\xff\xffshort")
    turned = np.asfortranarray(np.arange(24.0).reshape(4, 3, 2))
    np.save(tmp_path / "turned.npy", turned)
    splits = files.npy_splits(spark, str(tmp_path), rows_per_tile=3)
    assert splits.filter("error IS NOT NULL").count() == 1 and splits.filter("scene_id = 'big'").count() == 3000
    some = files.read_splits(splits.filter("scene_id <> 'big' OR tile_row IN (0, 1500, 2999)"), 3)
    rows = {(r.scene_id, r.tile_row): r for r in some.withColumn("_task", F.spark_partition_id()).collect()}
    assert list(rows["big", 0].data[:3]) == [0, 1, 2] and rows["big", 2999].data[2 * w + 5] == 9004 and not any(rows["big", 1500].data[:1000])
    assert rows["big", 2999].min_y == 8997 and len({r._task for k, r in rows.items() if k[0] == "big"}) > 1
    assert [list(rows["turned", k].data) for k in (0, 1)] == [turned[:3].reshape(-1).tolist(), turned[3:].reshape(-1).tolist()]
    assert rows["cut", 0].error


def test_members_are_unpacked_to_a_mirrored_tree(spark, tmp_path):
    """A folder below has the base's name; members of one archive go to several tasks; a name that leaves its folder is an error."""
    base = tmp_path / "data"
    (base / "a" / "data").mkdir(parents=True)
    with zipfile.ZipFile(base / "a" / "data" / "b.zip", "w") as z:
        for k in range(40):
            z.writestr(f"d/m{k}.txt", f"text {k} " * 1000, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.writestr("../out.txt", "no")
    for name, mode in (("t.tar", "w"), ("g.tar.gz", "w:gz")):
        with tarfile.open(base / name, mode) as t:
            for k in range(3):
                info = tarfile.TarInfo(f"{'long' * 40}/n{k}.txt")
                info.size = 5
                t.addfile(info, io.BytesIO(b"hi %02d" % k))
    (base / "bad.zip").write_bytes(b"broken")
    paths = {r.path for r in files.unpacked_paths(files.unpack(spark, str(base)), str(base)).filter("error IS NULL").collect()}
    assert "a/data/b/d/m0.txt" in paths and f"t/{'long' * 40}/n2.txt" in paths and f"g/{'long' * 40}/n0.txt" in paths
    rows = files.unpack_to(spark, str(base), str(tmp_path / "out")).withColumn("_task", F.spark_partition_id()).collect()
    assert len({r._task for r in rows if r.archive.endswith("b.zip")}) > 1
    good = {r.path for r in rows if r.error is None}
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, names in os.walk(tmp_path / "out") for f in names}
    assert good == found and len(good) == 46 and sum(r.error is not None for r in rows) == 2
    assert (tmp_path / "out" / "a" / "data" / "b" / "d" / "m7.txt").read_text() == "text 7 " * 1000


def test_catalogs_and_headers_are_read_from_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for k in (1, 2):
        (tmp_path / "c" / f"p{k}.json").write_text('{"data":\n {"results": [{"displayId": "s%d"}]}}' % k)
        (tmp_path / "h" / f"s{k}").mkdir(parents=True)
        (tmp_path / "h" / f"s{k}" / "part.txt").write_text(f"A = {k}\nB = 2")
    assert sorted(r.id for r in files.read_catalog(spark, str(tmp_path / "c")).selectExpr("explode(data.results.displayId) AS id").collect()) == ["s1", "s2"]
    assert sorted(map(tuple, files.read_headers(spark, str(tmp_path / "h"), level=1).collect())) == [("s1", "A = 1\nB = 2"), ("s2", "A = 2\nB = 2")]


def test_small_files_are_listed_and_read_by_few_tasks(spark, tmp_path):
    """Files of many folders are found by tasks, as Spark's listing has them, and a scan of each is not planned."""
    base = tmp_path / "in"
    for k in range(400):
        (base / f"b{k % 40}" / "c=1").mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(base / f"b{k % 40}" / "c=1" / f"{k}.zip", "w") as z:
            z.writestr("m.txt", f"text {k}")
    for name in (".hidden.zip", "_no.zip", "b1/_skip/x.zip", "b1/empty.zip", "b1/other.txt"):
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_bytes(b"" if "empty" in name else b"x")
    (base / "link.zip").symlink_to(base / "nowhere")
    found = files.listed(spark, str(base), ".zip")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(str(base / "b*"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.select("path", "length").collect())) and found.count() == 400
    assert files.archive_members(spark, str(base)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    rows = files.unpack(spark, str(base))
    assert rows.rdd.getNumPartitions() < 100
    got = rows.collect()
    assert {bytes(r.content).decode() for r in got if r.error is None} == {f"text {k}" for k in range(400)} and sum(r.error is not None for r in got) == 1
    one = str(base / "b3" / "c=1" / "3.zip")
    assert [r.path for r in files.listed(spark, one).collect()] == ["file:" + one]
    made = files.unpack_to(spark, str(base), str(tmp_path / "out"))
    assert made.rdd.getNumPartitions() < 100 and made.filter("error IS NULL").count() == 400
    assert files.listed(spark, str(tmp_path / "out")).count() == 400


def test_heights_beyond_16_bits_and_degrees_that_come_again(spark, tmp_path):
    """Scenes 4 and 184 are of the same degree; heights beyond 32,767 come back as they are."""
    rows = [(k * 2500 + i, 40_000 * (k - 3) + i, "F" if i % 7 else "P", 1.0, "1-URGENT") for k in (4, 184) for i in range(60)]
    table = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    table.write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog_queries.elevation_grids(spark, str(tmp_path)).collect()
    want = [(4, -4, i // 50, i % 50, float(c - 500) if s == "F" else None, 1 / 49.0) for k, c, s, _, _ in rows for i in [k % 2500]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_elevation_pixels_meet_no_join_and_keep_their_places(spark, tmp_path):
    """What pixels are made of is no measure of their size, by which they might be sent; a scene with gaps has the same gaps again."""
    rows = [(k * 2500 + i, 40_000 * k + i, "F" if i % 7 else "P", 1.0, "1-URGENT") for k in (2, 4) for i in (0, 3, 49, 50, 1007, 2499)]
    table = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    table.write.parquet(str(tmp_path / "orders.parquet"))
    df = catalog_queries.elevation_grids(spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    want = [(k, -k, i // 50, i % 50, float(c - 500) if s == "F" else None, 1 / 49.0) for o, c, s, _, _ in rows for k, i in [divmod(o, 2500)]]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_small_arrays_and_headers_are_read_by_few_tasks(spark, tmp_path):
    for k in range(300):
        np.save(tmp_path / f"{k}.npy", np.full((2, 2), k))
        (tmp_path / "h" / f"s{k}").mkdir(parents=True)
        (tmp_path / "h" / f"s{k}" / "part.txt").write_bytes(b"A = %d\n\xc3\xa9" % k)
    assert files.npy_splits(spark, str(tmp_path)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    tiles = files.read_npy(spark, str(tmp_path))
    assert tiles.rdd.getNumPartitions() < 20 and {r.scene_id: r.data[3] for r in tiles.collect()} == {str(k): k for k in range(300)}
    assert not files.invalid_inputs(files.discover(spark, str(tmp_path), "npy"), tiles).collect()
    headers = files.read_headers(spark, str(tmp_path / "h"), level=1)
    assert headers.rdd.getNumPartitions() < 20 and sorted(map(tuple, headers.collect())) == sorted((f"s{k}", f"A = {k}\n\u00e9") for k in range(300))


def test_paths_and_lengths_come_of_one_listing(spark, monkeypatch):
    calls, listed = [], files.listed
    monkeypatch.setattr(files, "listed", lambda *a: calls.append(a) or listed(*a))
    found = catalog_queries.QUERIES["ras001_paths_by_extension"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and found.columns == ["path", "length"] and len(calls) == 1


def test_batches_hold_a_folder_for_each_run(spark, tmp_path):
    """Scenes "7", "007" and NULL are three; one makes no rows; a lost row and a run without marks are made good, nothing twice."""
    out, worked = str(tmp_path / "out"), []
    names = ["7", "007", None, "none"] + [f"s{k}" for k in range(40)]
    inputs = spark.createDataFrame([(s, v) for s in names for v in range(3)], "scene_id string, v long")

    def work(rows):
        worked.append(sorted(str(r.scene_id) for r in rows.select("scene_id").distinct().collect()))
        return rows.filter("scene_id IS NULL OR scene_id <> 'none'").withColumn("v", F.col("v") * 2)

    def check():
        got = sorted((str(r.scene_id), r.v) for r in batch.results(spark, out).collect())
        assert got == sorted((str(s), 2 * v) for s in names for v in range(3) if s != "none")

    batch.resume(spark, inputs.filter("scene_id IN ('7', '007', 'none')"), out, work)
    assert batch.resume(spark, inputs, out, work).count() == len(names) - 3
    check()
    assert sorted(p.name for p in (tmp_path / "out" / "scenes").iterdir() if "=" in p.name) == ["attempt=0", "attempt=1"]
    # a row of "007" is lost, and a run ends before its marks
    inputs.filter("scene_id IN ('7', '007') AND (scene_id = '7' OR v > 0)").withColumn("v", F.col("v") * 2).coalesce(1).write.mode("overwrite").parquet(f"{out}/scenes/attempt=0")
    inputs.filter("scene_id = '7'").withColumn("v", F.col("v") * 5).coalesce(1).write.parquet(f"{out}/scenes/attempt=2")
    assert [r.scene_id for r in batch.resume(spark, inputs, out, work).collect()] == ["007"]
    check()
    assert batch.resume(spark, inputs, out, work).count() == 0
    assert worked == [["007", "7", "none"], sorted(str(s) for s in names if s not in ("7", "007", "none")), ["007"]]
    check()
