"""Exact cases for boxes and tile grids."""

import random

import pytest
from pyspark.sql import functions as F

from tileforge.functions import geometry as G
from tileforge.operators import grid


def tiles(spark, size, tile, container=None, **more):
    scenes = spark.createDataFrame([("a", *size)], "scene_id string, width int, height int")
    around = None if container is None else G.box(*[F.lit(v) for v in container])
    rows = grid.make_tile_grid(scenes, tile, container=around, **more).orderBy("tile_row", "tile_col").collect()
    return [tuple(r.tile) for r in rows], [tuple(r.valid) for r in rows]


def sides(boxes):
    return [(b[2] - b[0], b[3] - b[1]) for b in boxes]


def test_whole_tiles(spark):
    assert sides(tiles(spark, (10, 10), (5, 5), partials=False)[0]) == [(5, 5)] * 4
    assert len(tiles(spark, (10, 10), (5, 10), partials=False)[0]) == 2
    assert tiles(spark, (10, 10), (11, 11), partials=False) == ([], [])
    assert len(tiles(spark, (10, 10), (6, 6), partials=False)[0]) == 1


def test_partial_tiles(spark):
    assert tiles(spark, (10, 10), (11, 11))[0] == [(0, 0, 10, 10)]
    assert tiles(spark, (10, 10), (20, 20), least=(11, 11))[0] == []
    assert len(tiles(spark, (10, 10), (20, 20), least=(10, 10))[0]) == 1


@pytest.mark.parametrize("size", [(10, 10), (12, 10)])
def test_overlap(spark, size):
    found, valid = tiles(spark, size, (6, 6), overlap=(2, 2), partials=False)
    assert sides(found) == [(6, 6)] * 4 and sides(valid) == [(5, 5)] * 4


def test_shifted_back(spark):
    found, valid = tiles(spark, (10, 10), (6, 6), partials=False, shift_back=True)
    assert sides(found) == [(6, 6)] * 4
    assert sides(valid) == [(6, 6), (4, 6), (6, 4), (4, 4)]


def test_container(spark):
    assert len(tiles(spark, (12, 10), (7, 7), (0, 0, 20, 20), partials=False)[0]) == 4


def test_row_blocks(spark):
    scenes = spark.createDataFrame([("a", 10, 10)], "scene_id string, width int, height int")
    rows = grid.group_by_row_block(grid.make_tile_grid(scenes, (5, 5), partials=False)).collect()
    assert sorted(len(r.tiles) for r in rows) == [2, 2]
    assert all(tuple(r.tiles[0].tile)[:2] == (0, 0) for r in rows)


def test_box_measures(spark):
    b = G.box(F.lit(5), F.lit(10), F.lit(15), F.lit(30))
    row = spark.range(1).select(G.width(b).alias("w"), G.height(b).alias("h"), G.perimeter(b).alias("p"), G.area(b).alias("a"), G.contains_point(b, F.lit(15), F.lit(30)).alias("edge")).first()
    assert tuple(row) == (10, 20, 60, 200, True)


def test_owned_once_for_even_overlap(spark):
    px = spark.range(40 * 40).select(F.lit("a").alias("scene_id"), (F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"))
    owned = grid.covering_tiles(px, 16, 4, F.lit(40), F.lit(40)).filter("owned").groupBy("y", "x").count()
    assert owned.count() == 1600 and owned.filter("count <> 1").count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_tiles_and_back(spark, parts):
    px = spark.range(300).select(F.lit("a").alias("scene_id"), (F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("bands")).repartition(parts)
    back = grid.tiles_to_pixels(grid.pixels_to_tiles(px, 8, 8))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))


@pytest.mark.parametrize("most", [20_000, 3, 0])
def test_boxes_of_all_sizes_meet_once(spark, monkeypatch, most):
    """Small boxes, a few large ones and one over the whole plane, against a plain loop; grids sent, some sent, none sent."""
    monkeypatch.setattr(grid, "SENT_BOXES", most)
    rng = random.Random(3)

    def boxes(n, shift):
        out = [(k, (x := rng.randint(-300, 300)), (y := rng.randint(-300, 300)), x + rng.randint(0, 9), y + rng.randint(1, 9)) for k in range(n)]
        return out + [(n + k, -200 + 40 * k, shift, -100 + 90 * k, 120) for k in range(4)] + [(n + 4, -1000, -1000, 1000, 1000)]

    a, b = boxes(150, -90), boxes(120, 7)
    left, right = (spark.createDataFrame(rows, f"{n} long, x0 int, y0 int, x1 int, y1 int").select(n, G.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias(f"{n}_box")) for rows, n in ((a, "a"), (b, "b")))
    got = sorted((r.a, r.b) for r in grid.box_overlap_join(left, right, "a_box", "b_box", 8).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if p[3] > p[1] and q[3] > q[1] and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])
    assert got == want and len(want) > 300
    assert grid.box_overlap_join(left.limit(0), right, "a_box", "b_box", 8).count() == 0


def test_one_box_over_the_plane_gathers_nothing(spark):
    small = spark.range(40_000).select("id", G.box(F.col("id") % 200 * 10, F.floor(F.col("id") / 200) * 10, F.col("id") % 200 * 10 + 8, F.floor(F.col("id") / 200) * 10 + 8).alias("a_box"))
    other = small.select(F.col("id").alias("b"), F.col("a_box").alias("b_box")).unionByName(spark.createDataFrame([(-1, 0, 0, 3000, 3000)], "b long, x0 int, y0 int, x1 int, y1 int").select("b", G.box(*(F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1"))).alias("b_box")))
    pairs = grid.box_overlap_join(small, other, "a_box", "b_box", 10)
    assert pairs.count() == 80_000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
