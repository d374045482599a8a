"""Queries that once did a part of their job, against plain loops over the whole tables."""

import collections

import numpy as np
import pytest

from tests.conftest import SMALL
from tileforge.functions import kernels
from tileforge.jobs import demo, queries
from tileforge.operators import catalog


LARGER = "/root/testdata/sf0.01"


def run(spark, name, sf=SMALL):
    return queries.QUERIES[name](spark, sf).collect()


def meet(a, b):
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


def test_all_boxes_are_joined_with_all(spark):
    boxes = sorted((r.id, tuple(r.box)) for r in demo.customer_boxes(spark, SMALL).collect())
    want = {(i, j) for k, (i, a) in enumerate(boxes) for j, b in boxes[k + 1 :] if meet(a, b)}
    got = [tuple(r) for r in run(spark, "ras046_box_overlap_join")]
    assert len(got) == len(set(got)) and set(got) == want
    assert any((i % 10, j % 10) != (0, 1) for i, j in want)


def test_common_areas_are_of_all_scenes(spark):
    parts = collections.defaultdict(list)
    for r in demo.supplier_scenes(spark, LARGER).collect():
        parts[r.scene_id // 4].append((r.gt[0], r.gt[3] - r.height * 0.25, r.gt[0] + r.width * 0.5, r.gt[3]))
    areas = {k: (max(b[0] for b in p), max(b[1] for b in p), min(b[2] for b in p), min(b[3] for b in p)) for k, p in parts.items()}
    want = {k: a for k, a in areas.items() if a[0] < a[2] and a[1] < a[3]}
    got = {r.part: (r.min_x, r.min_y, r.max_x, r.max_y) for r in run(spark, "ras118_common_area", LARGER)}
    assert got == want and max(want) > 10


def test_labels_overlap_their_scene_on_its_date(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").collect()
    labels = sorted((e.event_id, e.ts.date(), (4 * e.user_id, v, 4 * e.user_id + 12, v + 8)) for e in events if e.event_type in ("click", "view") for v in [e.event_id * 7 % 20])
    want, most = set(), 0
    for e in events:
        if e.event_type not in ("click", "view"):
            b = (4 * e.user_id, e.event_id % 20, 4 * e.user_id + 60, e.event_id % 20 + 12)
            met = [k for k, d, o in labels if d == e.ts.date() and meet(b, o)]
            most = max(most, len(met))
            want |= {(e.event_id, k) for k in met[:12]}
    got = [tuple(r) for r in run(spark, "ras029_labels_on_date")]
    assert len(got) == len(set(got)) and set(got) == want and most > 12


def test_twelve_labels_of_the_date_and_place(spark):
    box = "struct<min_x:int,min_y:int,max_x:int,max_y:int>"
    scenes = spark.createDataFrame([("a", (0, 0, 40, 40), "2024-01-01"), ("b", (0, 0, 40, 40), "2024-01-02"), ("c", (90, 0, 99, 9), None)], f"scene_id string, box {box}, date string")
    rows = [(k, (k, k, k + 20, k + 20), "2024-01-01") for k in range(15)] + [(20, (40, 0, 50, 9), "2024-01-02"), (21, (39, 0, 50, 9), "2024-01-02"), (22, (90, 0, 99, 9), None)]
    labels = spark.createDataFrame(rows, f"label_id int, label_box {box}, date string")
    got = sorted(tuple(r) for r in catalog.labels_on_date(scenes, labels, 16).collect())
    assert got == [("a", k) for k in range(12)] + [("b", 21)]


def test_all_labels_of_the_date_and_place_are_put_together(spark):
    """Fifteen tiles of one pixel each beside one another, all over one larger tile: each has its place, the larger one the rest."""
    box = "struct<min_x:int,min_y:int,max_x:int,max_y:int>"
    scenes = spark.createDataFrame([("a", [0.0, 1.0, 0.0, 2.0, 0.0, -1.0], 16, 2, (0, 0, 16, 2), "2024-01-01")], f"scene_id string, gt array<double>, width int, height int, box {box}, date string")
    tiles = [(k, [float(k), 1.0, 0.0, 2.0, 0.0, -1.0], (k, 1, k + 1, 2), "2024-01-01") for k in range(1, 16)] + [(0, [0.0, 16.0, 0.0, 2.0, 0.0, -2.0], (0, 0, 16, 2), "2024-01-01")]
    labels = spark.createDataFrame(tiles, f"label_id int, label_gt array<double>, label_box {box}, date string")
    pixels = spark.createDataFrame([(k, 0, 0, 100 + k) for k in range(16)], "label_id int, y int, x int, label int")
    got = {(r.y, r.x): r.label for r in catalog.scene_labels(scenes, labels, pixels, 16).collect()}
    assert got == {(y, x): 100 + x if y == 0 else 100 for y in range(2) for x in range(16)}


def test_all_points_of_all_shapes(spark):
    square = [(0, False, [(10, 10), (30, 10), (30, 30), (10, 30), (10, 10)]), (0, True, [(15, 15), (25, 15), (25, 25), (15, 25), (15, 15)]), (1, False, [(44, 44), (49, 44), (49, 49), (44, 49), (44, 44)])]
    want = set()
    for scene in {r.scene_id for r in demo.orders_raster(spark, LARGER).select("scene_id").distinct().collect()}:
        k = int(scene[1:])
        triangle = [(0, False, [(k % 5 + 2, 5), (40.5, 8), (20, k % 7 + 38), (k % 5 + 2, 5)])]
        for shape, rings in ((1, triangle), (2, square)):
            want |= {(scene, shape, n, poly, hole, i, (x - 1.0) / 0.5, (y - 60.0) / -0.25) for n, (poly, hole, pts) in enumerate(rings) for i, (x, y) in enumerate(pts)}
    got = [tuple(r) for r in run(spark, "ras091_shapes_to_pixels", LARGER)]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name, kernel", [("ras124_fill_nodata", lambda p: kernels.fill_gaps(p, 16)), ("ras126_gaussian_blur", lambda p: kernels.blur(p, 9.0))])
def test_windows_are_those_of_the_reference(spark, name, kernel):
    """Reach 16 and sigma 9 on each scene in one piece."""
    planes = collections.defaultdict(lambda: np.full((demo.SIDE, demo.SIDE), np.nan))
    for r in demo.orders_raster(spark, SMALL).collect():
        planes[r.scene_id][r.y, r.x] = np.nan if name.startswith("ras124") and r.label == demo.NODATA else r.bands[0]
    rows = run(spark, name)
    height = {s: max(r.y for r in rows if r.scene_id == s) + 1 for s in planes}
    want = {s: kernel(p[: height[s]]) for s, p in planes.items()}
    near = lambda r: r.value == pytest.approx(want[r.scene_id][r.y, r.x], abs=6e-3) if r.value is not None else np.isnan(want[r.scene_id][r.y, r.x])
    assert rows and all(near(r) for r in rows)


def test_pixels_are_not_sent_by_an_estimate(spark):
    """Pixels that explodes made are joined by shuffles: estimates are of the rows before."""
    plan = queries.QUERIES["ras029_scene_label_rasters"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    physical = queries.QUERIES["ras029_scene_label_rasters"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("SortMergeJoin") >= 4


@pytest.mark.parametrize("name, most", [("ras121_resample_bilinear", 0), ("ras120_resample_nearest", 1), ("ras122_crop_or_pad", 1)])
def test_made_pixels_are_not_sent(spark, name, most):
    """Pixels that explodes made of few scenes are dealt over tasks and never broadcast; only stored ones may be, by their bytes."""
    df = queries.QUERIES[name](spark, SMALL)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastHashJoin") <= most and "BuildLeft" not in plan
    assert "Exchange RoundRobinPartitioning" in plan
