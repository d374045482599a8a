"""NumPy kernels against plain versions, and their independence of the tiling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileforge.functions import kernels as K
from tileforge.operators import scoring


def inside_polygon(x, y, rings):
    """Even-odd rule over all edges of all rings, point by point."""
    odd = np.zeros(x.shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def test_distance():
    rng = np.random.default_rng(1)
    mask = rng.random((9, 7)) < 0.2
    ys, xs = np.nonzero(mask)
    want = np.array([[np.hypot(ys - y, xs - x).min() for x in range(7)] for y in range(9)])
    assert np.allclose(K.distance_to(mask), want)


def test_similarity():
    rng = np.random.default_rng(2)
    a, b = rng.random((32, 32)), rng.random((32, 32))
    assert abs(1 - K.ms_ssim(a, a)) < 1e-9
    assert K.ms_ssim(np.zeros((180, 180)), np.zeros((180, 180))) == 1.0
    assert 0 <= K.ms_ssim(a, b) < 1


def plain_ms_ssim(a, b):
    """Every window on its own, with two-dimensional weights."""
    side = min(a.shape)
    n = 11 if side / 16 >= 11 else int(side / 16)
    at = np.arange(n) - (n - 1) / 2
    weights = np.exp(-(at[:, None] ** 2 + at**2) / (2 * 1.5**2))
    weights /= weights.sum()
    score = 1.0
    for k, power in enumerate((0.0448, 0.2856, 0.3001, 0.2363, 0.1333)):
        light, contrast = [], []
        for y in range(a.shape[0] - n + 1):
            for x in range(a.shape[1] - n + 1):
                p, q = a[y : y + n, x : x + n], b[y : y + n, x : x + n]
                mp, mq = (weights * p).sum(), (weights * q).sum()
                vp, vq, cov = (weights * (p - mp) ** 2).sum(), (weights * (q - mq) ** 2).sum(), (weights * (p - mp) * (q - mq)).sum()
                contrast.append((2 * cov + 0.12**2) / (vp + vq + 0.12**2))
                light.append((2 * mp * mq + 0.04**2) / (mp**2 + mq**2 + 0.04**2) * contrast[-1])
        score *= max(0.0, np.mean(light if k == 4 else contrast)) ** power
        if k < 4:
            half = lambda z: np.array([[z[y : y + 2, x : x + 2].mean() for x in range(0, z.shape[1], 2)] for y in range(0, z.shape[0], 2)])
            a, b = half(a), half(b)
    return score


@pytest.mark.parametrize("side", [48, 64, 90])
def test_similarity_equals_plain_windows(side):
    rng = np.random.default_rng(side)
    a = rng.random((side, side)) * 4
    b = a + rng.random((side, side))
    assert K.ms_ssim(a, b) == pytest.approx(plain_ms_ssim(a, b), rel=1e-9)
    assert K.ms_ssim_mse(a, b) == pytest.approx(1 - plain_ms_ssim(a, b) + np.mean((a - b) ** 2), rel=1e-9)


def reflected(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * n - 2 - i
    return i


def test_rotation_equals_plain_loops():
    rng = np.random.default_rng(5)
    a = rng.random((9, 12, 2))
    for degrees in (0, 13, -33, 90, 171):
        turn = np.radians(degrees)
        want = np.empty_like(a)
        for y in range(9):
            for x in range(12):
                sy = np.cos(turn) * (y - 4) - np.sin(turn) * (x - 5.5) + 4
                sx = np.sin(turn) * (y - 4) + np.cos(turn) * (x - 5.5) + 5.5
                want[y, x] = a[reflected(int(np.floor(sy + 0.5)), 9), reflected(int(np.floor(sx + 0.5)), 12)]
        assert np.array_equal(K.rotate(a, degrees), want)
    assert np.array_equal(K.rotate(a, 0), a)


def test_surface_loss_equals_plain_loops():
    rng = np.random.default_rng(6)
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        t, p = (rng.random((9, 13)) < share).astype(float), rng.random((9, 13))
        ones, zeros = list(zip(*np.nonzero(t))), list(zip(*np.nonzero(1 - t)))
        far = lambda y, x, cells: min(((y - v) ** 2 + (x - u) ** 2) ** 0.5 for v, u in cells)
        total = 0.0
        for y in range(9):
            for x in range(13):
                own, other = (ones, zeros) if t[y, x] else (zeros, ones)
                # inside its mask a cell is 1 less than its distance to the other one, below zero; outside it is the distance
                inside = 1 - far(y, x, other) if other else 0.0
                outside = far(y, x, other) if other else 0.0
                # p goes with the mask of zeros, 1 - p with that of ones
                total += p[y, x] * (outside if t[y, x] else inside) + (1 - p[y, x]) * (inside if t[y, x] else outside)
        assert K.surface_loss(t, p) == pytest.approx(total / (9 * 13))
    assert K.surface_loss(np.array([[1.0, 1, 0, 0]]), np.array([[1.0, 1, 0, 0]])) == pytest.approx(1.5)


def test_similarity_of_bands_is_the_mean_over_bands():
    rng = np.random.default_rng(9)
    a = rng.random((64, 64, 3)) * 4
    b = np.clip(a + rng.normal(0, 0.3, a.shape), 0, 4)
    b[..., 2] = rng.random((64, 64)) * 4
    each = [K.ms_ssim(a[..., k], b[..., k]) for k in range(3)]
    assert K.ms_ssim(a, b) == pytest.approx(np.mean(each)) and len({round(e, 3) for e in each}) == 3
    assert K.ms_ssim(a, a) == pytest.approx(1) and K.ms_ssim_mse(a, b) == pytest.approx(1 - np.mean(each) + ((a - b) ** 2).mean())


def test_filling_equals_plain_loops():
    rng = np.random.default_rng(7)
    image = rng.random((14, 11))
    image[rng.random((14, 11)) < 0.5] = np.nan
    image[:, 6:] = np.nan
    first = image.copy()
    for y, x in zip(*np.nonzero(np.isnan(image))):
        near = [(1 / np.hypot(v - y, u - x), image[v, u]) for v in range(14) for u in range(11) if not np.isnan(image[v, u]) and np.hypot(v - y, u - x) <= 3]
        first[y, x] = sum(w * z for w, z in near) / sum(w for w, _ in near) if near else np.nan
    want = first.copy()
    for y, x in zip(*np.nonzero(np.isnan(image) & ~np.isnan(first))):
        want[y, x] = np.nanmean(first[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2])
    assert np.allclose(K.fill_gaps(image, 3), want, equal_nan=True) and np.isnan(want).any()


def test_blur_equals_plain_loops():
    rng = np.random.default_rng(8)
    image = rng.random((10, 7))
    k = 8
    g = [np.exp(-0.5 * (d / 2.0) ** 2) for d in range(-k, k + 1)]
    at = lambda i, n: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    want = [[sum(g[dy + k] * g[dx + k] * image[at(y + dy, 10), at(x + dx, 7)] for dy in range(-k, k + 1) for dx in range(-k, k + 1)) / sum(g) ** 2 for x in range(7)] for y in range(10)]
    assert np.allclose(K.blur(image, 2.0), want)


def test_surface_loss_of_empty_mask_is_zero():
    assert K.surface_loss(np.zeros((4, 4)), np.zeros((4, 4))) == 0.0


def test_patches_give_what_the_whole_gives():
    a = np.random.default_rng(3).random((8, 8, 2))
    model = lambda x: x.sum(axis=3, keepdims=True)
    assert np.allclose(K.run_model(model, a), K.run_model(model, a, (4, 4), batch_bytes=300))


def plane(spark, image):
    h, w = image.shape
    return spark.createDataFrame([("a", y, x, None if np.isnan(image[y, x]) else float(image[y, x])) for y in range(h) for x in range(w)], "scene_id string, y int, x int, value double")


def grid_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r.value is None else r.value
    return out


def test_fill_and_blur_do_not_depend_on_the_tile(spark):
    rng = np.random.default_rng(4)
    image = rng.random((30, 30))
    gaps = image.copy()
    gaps[rng.random((30, 30)) < 0.4] = np.nan
    for tile in (8, 64):
        assert np.allclose(grid_of(scoring.fill_nodata(plane(spark, gaps), 3, tile), image.shape), K.fill_gaps(gaps, 3), equal_nan=True)
        assert np.allclose(grid_of(scoring.gaussian_blur(plane(spark, image), 1.0, tile), image.shape), K.blur(image, 1.0))


def test_polygon_kernel_agrees_with_columns(spark):
    from tileforge.operators import regions

    wkt = "POLYGON ((1 1, 9 2, 7 9, 2 8, 1 1), (3 3, 6 3, 6 6, 3 6, 3 3))"
    shapes = spark.createDataFrame([("a", 1, wkt)], "scene_id string, shape_id long, wkt string").select("scene_id", "shape_id", regions.parse_wkt(F.col("wkt")).alias("rings"))
    got = {(r.y, r.x) for r in regions.shape_pixels(shapes, 10, 10).collect()}
    y, x = np.mgrid[:10, :10] + 0.5
    rings = [np.array([(1, 1), (9, 2), (7, 9), (2, 8)]), np.array([(3, 3), (6, 3), (6, 6), (3, 6)])]
    assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(inside_polygon(x, y, rings)))))


def test_scan_lines_agree_with_the_polygon_kernel(spark):
    """Many random shapes with holes and overlapping polygons, beyond the raster too, painted ring by ring; alone and one over another."""
    from tileforge.operators import regions

    rng = np.random.default_rng(9)
    rings, want = [], set()
    y, x = np.mgrid[:20, :24] + 0.5
    together = np.zeros(y.shape, bool)
    for shape in range(25):
        own, inside = [], np.zeros(y.shape, bool)
        for poly in range(2):
            parts = [rng.uniform(-4, 26, (rng.integers(3, 7), 2)).round(rng.integers(0, 2)) for _ in range(rng.integers(1, 3))]
            own += [(poly, k > 0, [tuple(map(float, p)) for p in part]) for k, part in enumerate(parts)]
            for k, part in enumerate(parts):
                for image in (inside, together):
                    image[inside_polygon(x, y, [part])] = k == 0
        rings.append(("a", shape, own))
        want |= {(shape, int(v), int(u)) for v, u in zip(*np.nonzero(inside))}
    df = spark.createDataFrame(rings, "scene_id string, shape_id long, rings array<struct<poly:int,hole:boolean,pts:array<struct<x:double,y:double>>>>")
    got = [(r.shape_id, r.y, r.x) for r in regions.shape_pixels(df, 24, 20).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [(r.y, r.x) for r in regions.span_pixels(regions.row_spans(df, 24, 20, "scene_id"), "scene_id").collect()]
    assert len(got) == len(set(got)) and set(got) == set(zip(*map(lambda v: v.tolist(), np.nonzero(together))))


def test_large_and_small_boxes_meet_once(spark):
    from tileforge.operators import grid

    rng = np.random.default_rng(10)
    box = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"

    def made(n):
        low = rng.uniform(-50, 400, (n, 2)).round(1)
        return [(k, (*map(float, a), *map(float, (a + s).round(1)))) for k, (a, s) in enumerate(zip(low, 10 ** rng.uniform(-0.5, 2.7, (n, 2))))]

    left, right = made(80), made(90)
    got = [tuple(r) for r in grid.box_overlap_join(spark.createDataFrame(left, f"i int, a {box}"), spark.createDataFrame(right, f"j int, b {box}"), "a", "b", 16).select("i", "j").collect()]
    want = {(i, j) for i, a in left for j, b in right if min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_turned_tiles_equal_turned_pixels(spark):
    """The kernel on whole tiles, by ``map_tiles``, and the operator on pixels; labels turn with the image."""
    import hashlib

    from tileforge.operators import sampling

    angle = lambda scene: (2 * int(hashlib.md5(f"3:angle:{scene}".encode()).hexdigest()[:8], 16) / 4294967296 - 1) * 40
    rows = [(s, y, x, float(100 * y + x), y * 7 + x) for s in ("a", "b") for y in range(9) for x in range(12)]
    px = spark.createDataFrame(rows, "scene_id string, y int, x int, value double, label int")
    got = {(r.scene_id, r.y, r.x): (r.value, r.label) for r in sampling.rotated(px, 12, 9, 40, 3).collect()}
    tiles = spark.createDataFrame([(s, 9, 12, 2, [v for _, y, x, a, b in rows if _ == s for v in (a, float(b))]) for s in ("a", "b")], "scene_id string, height int, width int, n_bands int, data array<double>")
    turned = sampling.map_tiles(tiles, lambda image, scene: K.rotate(image, angle(scene)))
    for r in turned.collect():
        image = np.array(r.data).reshape(9, 12, 2)
        assert all(got[(r.scene_id, y, x)] == (image[y, x, 0], image[y, x, 1]) for y in range(9) for x in range(12))
    assert len(got) == len(rows) and any(got[(s, y, x)] != (v, n) for s, y, x, v, n in rows)


def test_crops_and_pads(spark):
    from tileforge.operators import sampling

    px = spark.createDataFrame([("a", y, x, 10 * y + x) for y in range(4) for x in range(6)], "scene_id string, y int, x int, label int")
    assert sorted(tuple(r)[1:] for r in sampling.centre_crop(px, 6, 4, 2, 2).collect()) == [(0, 0, 12), (0, 1, 13), (1, 0, 22), (1, 1, 23)]
    padded = {(r.y, r.x): r.label for r in sampling.centre_crop(px, 6, 4, 8, 6, {"label": 0}).collect()}
    assert len(padded) == 48 and padded[(0, 0)] == 0 and padded[(1, 1)] == 0 and padded[(1, 2)] == 1 and padded[(4, 6)] == 35


def test_positions_are_gapless_whatever_the_number_of_parts(spark, monkeypatch):
    from tileforge.operators import sampling

    samples = spark.range(3000).withColumnRenamed("id", "k")
    one = {r.k: r.position for r in sampling.numbered(samples, sampling.shuffle_key(1, 2, "k"), ["k"]).collect()}
    monkeypatch.setattr(sampling, "ORDERED", 10)
    many = {r.k: r.position for r in sampling.numbered(samples, sampling.shuffle_key(1, 2, "k"), ["k"]).collect()}
    assert one == many and sorted(one.values()) == list(range(3000))


@pytest.mark.parametrize("shape", [(9, 7), (40, 150), (20, 300)])
def test_near_sums_are_those_of_a_plain_loop(shape):
    """Blocks of columns, and a fill that makes no pass for each offset of its reach."""
    rng = np.random.default_rng(3)
    plane = rng.random(shape)
    weight = lambda far: 1 / far if 0 < far <= 4 else 0.0
    got = K.near_sums([plane], 4)[0]
    for y, x in zip(rng.integers(0, shape[0], 60), rng.integers(0, shape[1], 60)):
        want = sum(plane[b, a] * weight(np.hypot(b - y, a - x)) for b in range(max(0, y - 4), min(shape[0], y + 5)) for a in range(max(0, x - 4), min(shape[1], x + 5)))
        assert got[y, x] == pytest.approx(want)
    plane[rng.random(shape) < 0.4] = np.nan
    plane[:, :3] = np.nan
    lone = plane.copy()
    lone[0, -1] = np.inf  # goes the other way; out of reach of the first columns
    assert np.allclose(K.fill_gaps(plane, 2)[:, :2], K.fill_gaps(lone, 2)[:, :2], equal_nan=True)
