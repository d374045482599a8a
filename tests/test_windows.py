"""Windows over stored tiles against the plain grid, samples changed by epoch, streams with state by scene."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileforge.functions import geometry as G, kernels as K
from tileforge.operators import grid, sampling, scoring, windows
from tileforge.sources import files
from tileforge.streaming import scenes as streams


def made_blocks(spark, sizes, side, bands=2):
    """Blocks of random scenes, and the scenes as arrays."""
    rng, rows, images = np.random.default_rng(1), [], {}
    for k, (w, h) in enumerate(sizes):
        images[f"s{k}"] = image = rng.random((h, w, bands))
        for y in range(0, h, side):
            for x in range(0, w, side):
                part = image[y : y + side, x : x + side]
                rows.append((f"s{k}", y // side, x // side, x, y, x + part.shape[1], y + part.shape[0], bands, part.reshape(-1).tolist()))
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "scene_id string, tile_row int, tile_col int, min_x int, min_y int, max_x int, max_y int, n_bands int, data array<double>"), images


@pytest.mark.parametrize("tile, overlap, bounds", [((20, 20), (6, 6), None), ((7, 9), (0, 0), None), ((10, 8), (3, 5), None), ((12, 12), (4, 4), (13, 5, 40, 22)), ((9, 30), (2, 1), (0, 3, 31, 30))])
def test_windows_are_those_of_the_grid(spark, tile, overlap, bounds):
    sizes = [(50, 30), (20, 20), (7, 40), (33, 31), (45, 64)]
    blocks, images = made_blocks(spark, sizes, 16)
    scenes = spark.createDataFrame([(f"s{k}", w, h) for k, (w, h) in enumerate(sizes)], "scene_id string, width int, height int")
    rect = None if bounds is None else G.box(*map(F.lit, bounds))
    whole = G.box(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    want = {(r.scene_id, r.tile_row, r.tile_col): (tuple(r.tile), tuple(r.valid)) for r in grid.make_tile_grid(scenes, tile, overlap, partials=False, shift_back=True, rect=rect, container=whole).collect()}
    got = windows.with_data(windows.overlapping_tiles(blocks, scenes, tile, overlap, bounds=bounds, block=(16, 16))).collect()
    assert {(r.scene_id, r.tile_row, r.tile_col): ((r.min_x, r.min_y, r.max_x, r.max_y), (r.v_min_x, r.v_min_y, r.v_max_x, r.v_max_y)) for r in got} == want and len(got) == len(want) > 0
    for r in got:
        assert np.array_equal(np.array(r.data).reshape(tile[1], tile[0], 2), images[r.scene_id][r.min_y : r.max_y, r.min_x : r.max_x])


def test_bounds_prune_folders_and_strips_move_once(spark, tmp_path):
    px = spark.range(64 * 64).select(F.lit("s").alias("scene_id"), F.floor(F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), F.array(F.col("id").cast("double")).alias("bands"))
    files.write_tiles(px, str(tmp_path / "t"), 16, by_row=True)
    blocks = spark.read.parquet(str(tmp_path / "t"))
    scenes = spark.createDataFrame([("s", 64, 64)], "scene_id string, width int, height int")
    out = scoring.score_tiles(windows.overlapping_tiles(blocks, scenes, (8, 8), (2, 2), bounds=(0, 50, 20, 64), block=(16, 16)), lambda a: a)
    plan = out._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "tile_row" in filters and plan.count("Exchange hashpartitioning") == 1
    read = windows.windows_of(blocks, scenes, (8, 8), (2, 2), bounds=(0, 50, 20, 64), block=(16, 16)).select("tile_row").distinct().collect()
    assert sorted(r.tile_row for r in read) == [3]


def test_nodata_types_and_transforms(spark):
    blocks, images = made_blocks(spark, [(24, 24)], 8)
    blocks = blocks.withColumn("data", F.transform("data", lambda v, k: F.when((k % 2 == 0) & (v < 0.3), 0.25).otherwise(v)))
    scenes = spark.createDataFrame([("s0", 24, 24)], "scene_id string, width int, height int")
    tiles = windows.overlapping_tiles(blocks, scenes, (12, 12), (4, 4))
    shrink = lambda a: a[:, 1:-1, 1:-1, 1:2] * 2
    first = np.where(images["s0"][..., 0] < 0.3, 0.25, images["s0"][..., 0])
    for dtype, kind in (("double", "double"), ("byte", "smallint"), ("float", "float")):
        scored = scoring.score_tiles(tiles, shrink, nodata=0.25, transform=lambda out: np.concatenate([out, out + 120], axis=-1), dtype=dtype)
        assert scored.schema["scores"].dataType.elementType.simpleString() == kind
        px = {(r.y, r.x): r.probs for r in scoring.stitch(scored).collect()}
        assert len(px) == 22 * 22
        for (y, x), p in px.items():
            value = images["s0"][y, x, 1] * 2
            if first[y, x] == 0.25:
                assert p == [0, 0] if dtype == "byte" else p == [None, None]
            else:
                assert p == pytest.approx([int(value), int(value + 120)] if dtype == "byte" else [value, value + 120], rel=1e-6)


STEPS = [{"random_flip_left_right": {"probability": 0.5}}, "random_rotate", {"random_translate": {"probability": 0.9, "max_pixels": 4}}, {"random_brightness": {"probability": 0.5}}, {"random_flip_up_down": {"probability": 0.5}}]


def test_samples_are_changed_as_plain_steps_would(spark):
    """Each step done for itself on whole arrays, with the draws that the plan makes; labels smaller than images."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.random(9 * 12 * 3).tolist(), rng.integers(0, 5, 5 * 6).tolist(), "kept") for k in range(40)]
    samples = spark.createDataFrame(rows, "id long, image array<double>, label array<int>, other string").repartition(3)
    args = (samples, STEPS, ["id"], (9, 12), (5, 6))
    out = sampling.augment_samples(*args, seed=5, epochs=2)
    assert "Exchange" not in sampling.augment_samples(samples.coalesce(1), *args[1:], seed=5, epochs=2)._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "").split("MapInPandas")[0]
    got = {(r.epoch, r.id): r for r in out.collect()}
    assert len(got) == 80 and out.columns == ["id", "image", "label", "other", "epoch"]
    draws = [sampling._drawn(s, k, 5, [F.col("epoch"), F.col("id")])[2].alias(f"d{k}") for k, s in enumerate(STEPS)]
    drawn = {(r.epoch, r.id): r for r in samples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("epoch", "id", *draws).collect()}
    for key, r in got.items():
        d = [drawn[key][f"d{k}"] for k in range(5)]
        source = dict((i, (a, b)) for i, a, b, _ in rows)[key[1]]
        for flat, found, (h, w) in ((source[0], r.image, (9, 12)), (source[1], r.label, (5, 6))):
            z = np.array(flat).reshape(h, w, -1)
            z = z[:, ::-1] if d[0][0] else z
            z = K.rotate(z, np.degrees(d[1][0]))
            z = z[K.mirror(np.arange(h) - int(d[2][1]), h)][:, K.mirror(np.arange(w) - int(d[2][0]), w)]
            z = z * d[3][0] if flat is source[0] else z
            z = z[::-1] if d[4][0] else z
            assert np.allclose(z.reshape(-1), found)
    assert sum(got[0, k].image != got[1, k].image for k in range(40)) > 30
    again = sampling.augment_samples(samples.repartition(7), *args[1:], seed=5, epochs=2)
    assert {(r.epoch, r.id): r for r in again.collect()} == got


def test_flips_of_two_by_two(spark):
    samples = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0], [0, 1, 2, 3])], "id long, image array<double>, label array<int>")
    r = sampling.augment_samples(samples, [{"random_flip_left_right": {"probability": 1.0}}, {"random_flip_up_down": {"probability": 1.0}}], ["id"], (2, 2)).first()
    assert r.image == [3, 2, 1, 0] and r.label == [3, 2, 1, 0]
    with pytest.raises(ValueError):
        sampling.augment_samples(samples, ["random_zoom"], ["id"], (2, 2))


def test_scenes_report_once_however_tiles_come(spark, tmp_path):
    """Tiles one to a trigger, some of them again before and after their scene is whole; one scene never is."""
    rng = random.Random(4)
    tiles = [(f"s{s}", r, c, 4, [rng.randint(0, 2) for _ in range(6)], [rng.randint(0, 2) for _ in range(6)]) for s in range(3) for r in range(2) for c in range(2)]
    schema = "scene_id string, tile_row int, tile_col int, n_tiles int, labels array<int>, preds array<int>"
    order = [t for t in tiles if t[:3] != ("s2", 1, 1)]
    rng.shuffle(order)
    order += order[:4]
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(0, len(order), 5):
        spark.createDataFrame(order[k : k + 5], schema).coalesce(1).write.mode("append").parquet(src)
        streams.process_new(streams.scene_confusion(streams.read_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1), 2, 2), out, check).awaitTermination()
    got = sorted((r.scene_id, r.true_class, r.pred_class, r.n) for r in spark.read.parquet(out).collect())
    want = []
    for s in ("s0", "s1"):
        for t in range(2):
            for p in range(2):
                want.append((s, t, p, sum(a == t and b == p for q in tiles if q[0] == s for a, b in zip(q[4], q[5]))))
    assert got == want


def test_scenes_of_several_sizes_are_mirrored_by_their_own(spark):
    sizes = {"a": (4, 3), "b": (7, 5)}
    rows = [(s, y, x, w, h, float(100 * y + x)) for s, (w, h) in sizes.items() for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "scene_id string, y int, x int, w int, h int, value double")
    for r in sampling.flips(px, F.col("w"), F.col("h"), 1.0, 3).collect():
        w, h = sizes[r.scene_id]
        assert r.value == 100 * (h - 1 - r.y) + w - 1 - r.x
    moved = sampling.translated(px, F.col("w"), F.col("h"), 3, 5).collect()
    assert len(moved) == len(rows)
    for s, (w, h) in sizes.items():
        got = {(r.y, r.x): r.value for r in moved if r.scene_id == s}
        want = [{(y, x): 100.0 * K.mirror(np.array([y - dy]), h)[0] + K.mirror(np.array([x - dx]), w)[0] for y in range(h) for x in range(w)} for dy in range(-3, 4) for dx in range(-3, 4)]
        assert got in want


def test_rows_of_tiles_are_folders_of_all_scenes(spark, tmp_path):
    px = spark.createDataFrame([(f"s{k}", y, x, [1.0 * k]) for k in range(40) for y in range(3) for x in range(2)], "scene_id string, y int, x int, bands array<double>")
    files.write_tiles(px, str(tmp_path / "t"), 2, by_row=True)
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["tile_row=0", "tile_row=1"]
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 2
    tiles = spark.read.parquet(str(tmp_path / "t")).collect()
    assert sorted((r.scene_id, r.tile_row, len(r.data)) for r in tiles) == sorted((f"s{k}", r, 4 - 2 * r) for k in range(40) for r in (0, 1))


def test_batches_of_tiles_are_objects_a_slice_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(100)), "data": [np.full(40_000, k, float) for k in range(100)]})
    frames = list(windows.slices([batch]))
    assert sum(map(len, frames)) == 100 and max(f["data"].map(len).sum() * 8 for f in frames) <= 2 * windows.SLICE_BYTES
    assert [f["data"].iloc[0][0] for f in frames] == [f["k"].iloc[0] for f in frames]
