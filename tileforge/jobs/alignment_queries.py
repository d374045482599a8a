"""Queries over mosaics, resampling, terrain, scoring and regions."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import align, catalog, grid, regions, scoring, windows
from ..sources import files
from . import demo
from .geometry_queries import flat

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = ["scene_id", "y", "x"]


def scratch(spark) -> str:
    return os.path.join(files.shared_folder(spark), f"scratch-{uuid.uuid4().hex}")


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _facts(spark, sf):
    """Supplier scenes with a projection, a type and a number of bands."""
    k = F.col("scene_id")
    return demo.supplier_scenes(spark, sf).withColumns({"projection": F.concat(F.lit("P"), (k % 3).cast("string")), "dtype": F.when(k % 4 == 0, "byte").otherwise("float"), "n_bands": (k % 2 + 1).cast("int")})


@register("ras116_images_equivalent", f"""
WITH {demo.SCENES}, f AS (SELECT *, scene_id % 3 AS projection, scene_id % 4 = 0 AS dtype, scene_id % 2 AS n_bands, (width, height) AS size, 1 AS resolution, (gx, gy - height * 0.25, gx + width * 0.5, gy) AS coverage FROM scenes)
SELECT a.scene_id, a.projection = b.projection AS projection, a.dtype = b.dtype AS dtype, a.n_bands = b.n_bands AS n_bands, a.size = b.size AS size, a.resolution = b.resolution AS resolution, a.coverage = b.coverage AS coverage,
    a.projection = b.projection AND a.dtype = b.dtype AND a.n_bands = b.n_bands AND a.resolution = b.resolution AS may_merge FROM f a JOIN f b ON b.scene_id = a.scene_id + 60""")
def images_equivalent(spark, sf):
    """Each of the six checks alone, and those that merging asks for together."""
    facts = align.comparable(_facts(spark, sf)).select("scene_id", "facts")
    rows = facts.withColumnRenamed("facts", "a").join(facts.select((F.col("scene_id") - 60).alias("scene_id"), F.col("facts").alias("b")), "scene_id")
    for check in align.CHECKS:
        rows = align.images_equivalent(rows, [check]).withColumnRenamed("same", check)
    return align.images_equivalent(rows, ["projection", "dtype", "n_bands", "resolution"]).withColumnRenamed("same", "may_merge").drop("a", "b")


FOOT = f"{demo.SCENES}, f AS (SELECT scene_id, gx AS x0, gy - height * 0.25 AS y0, gx + width * 0.5 AS x1, gy AS y1 FROM scenes)"


def _window_sql(s: str) -> str:
    return f"trunc((min_x - {s}.gx) / 0.5)::BIGINT AS {s}_min_x, trunc((max_y - {s}.gy) / -0.25)::BIGINT AS {s}_min_y, trunc((max_x - {s}.gx) / 0.5)::BIGINT AS {s}_max_x, trunc((min_y - {s}.gy) / -0.25)::BIGINT AS {s}_max_y"


@register("ras117_overlap_region", f"""
WITH {FOOT}, m AS (SELECT a.scene_id, greatest(a.x0, b.x0) AS min_x, greatest(a.y0, b.y0) AS min_y, least(a.x1, b.x1) AS max_x, least(a.y1, b.y1) AS max_y FROM f a JOIN f b ON b.scene_id = a.scene_id + 1),
n AS (SELECT scene_id, CASE WHEN ok THEN min_x END AS min_x, CASE WHEN ok THEN min_y END AS min_y, CASE WHEN ok THEN max_x END AS max_x, CASE WHEN ok THEN max_y END AS max_y FROM (SELECT *, max_x >= min_x AND max_y >= min_y AS ok FROM m))
SELECT n.*, {_window_sql('a')}, {_window_sql('b')} FROM n JOIN scenes a ON a.scene_id = n.scene_id JOIN scenes b ON b.scene_id = n.scene_id + 1""")
def overlap_region(spark, sf):
    """The geo box that neighbours share and the same in pixels of each; NULLs for neighbours apart."""
    s = demo.supplier_scenes(spark, sf).select("scene_id", F.struct("gt", "width", "height").alias("one"))
    pairs = s.join(s.select((F.col("scene_id") - 1).alias("scene_id"), F.col("one").alias("two")), "scene_id")
    rows = align.overlap_windows(pairs, "one", "two")
    return rows.select("scene_id", *flat("", F.col("area")), *flat("a_", F.col("a_window")), *flat("b_", F.col("b_window")))


@register("ras118_common_area", f"WITH {FOOT} SELECT * FROM (SELECT scene_id // 4 AS part, max(x0) AS min_x, max(y0) AS min_y, min(x1) AS max_x, min(y1) AS max_y FROM f GROUP BY scene_id // 4) WHERE min_x < max_x AND min_y < max_y")
def common_area(spark, sf):
    """Of all scenes, in parts of four neighbours."""
    f = demo.supplier_scenes(spark, sf).select(F.floor(F.col("scene_id") / 4).alias("part"), G.footprint(F.col("gt"), F.col("width"), F.col("height")).alias("box"))
    return align.common_area(f, "box", "part")


@register("ras119_mosaic", f"""
WITH {demo.PX}, g AS (SELECT y AS gy, x + 40 * substr(scene_id, 2)::INT AS gx, substr(scene_id, 2)::INT AS idx, v FROM px)
SELECT gy, gx::INT AS gx, arg_max(v, idx) AS v FROM g GROUP BY gy, gx""")
def mosaic(spark, sf):
    """Scenes side by side, ten columns of overlap; the later scene wins."""
    index = F.substring("scene_id", 2, 9).cast("int")
    px = demo.orders_raster(spark, sf).select(F.col("y").alias("gy"), (F.col("x") + 40 * index).alias("gx"), index.alias("idx"), "bands")
    return align.mosaic(px, "idx").select("gy", "gx", F.get("bands", F.lit(0)).alias("v"))


@register("ras119_mosaic_by_geotransform", f"""
WITH {demo.PX}, s AS (SELECT DISTINCT substr(scene_id, 2)::INT AS idx FROM px), t AS (SELECT idx, idx // 3 AS part, 40 * (idx % 3) AS ox, 20 * (idx % 2) AS oy, CASE WHEN idx % 6 = 5 THEN 1 ELSE 0 END AS odd FROM s),
h AS (SELECT substr(scene_id, 2)::INT AS idx, max(y) + 1 AS h FROM px GROUP BY scene_id),
g AS (SELECT part, min(ox) AS x0, min(oy) AS y0, max(ox) + 50 - min(ox) AS w, max(oy + h) - min(oy) AS h FROM t JOIN h USING (idx) GROUP BY part HAVING count(DISTINCT odd) = 1),
p AS (SELECT part, y + oy - y0 AS y, x + ox - x0 AS x, arg_max(px.v, idx) AS v FROM px JOIN t ON idx = substr(scene_id, 2)::INT JOIN g USING (part) GROUP BY ALL)
SELECT g.part, a.k::INT AS y, b.k::INT AS x, coalesce(p.v, -1.0) AS v FROM g, LATERAL (SELECT unnest(range(g.h)) AS k) a, LATERAL (SELECT unnest(range(g.w)) AS k) b LEFT JOIN p ON p.part = g.part AND p.y = a.k AND p.x = b.k""".replace(" GROUP BY ALL)\nSELECT g.part", " GROUP BY part, y + oy - y0, x + ox - x0)\nSELECT g.part"))
def mosaic_by_geotransform(spark, sf):
    """Mosaics of three scenes each, placed by geotransform; parts with a scene of another type are left out, gaps are -1."""
    px = demo.orders_raster(spark, sf)
    k = F.substring("scene_id", 2, 18).cast("int")
    s = px.groupBy("scene_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).withColumn("idx", k)
    gt = F.array((1000 + 40 * (k % 3) * 0.5).cast("double"), F.lit(0.5), F.lit(0.0), (500 - 20 * (k % 2) * 0.25).cast("double"), F.lit(0.0), F.lit(-0.25))
    s = s.withColumns({"part": F.floor(k / 3).cast("int"), "gt": gt, "projection": F.lit("P"), "dtype": F.when(k % 6 == 5, "byte").otherwise("float"), "n_bands": F.lit(1)})
    one = px.select(*KEY, F.array(F.get("bands", F.lit(0))).alias("bands"))
    return align.mosaic_scenes(s, one, "part", "idx", -1.0).select("part", "y", "x", F.get("bands", F.lit(0)).alias("v"))


@register("ras062_calibrated_scenes", f"""
WITH {demo.PX}, c AS (SELECT *, substr(scene_id, 2)::INT AS k FROM px)
SELECT scene_id, y, x, round((v * 0.00002::DOUBLE - 0.1::DOUBLE) / sin(radians(30.0::DOUBLE + k % 40)), 6) AS reflectance,
       round(CASE WHEN w > 0 THEN (1300.0::DOUBLE + k % 7) / ln(770.0::DOUBLE / (w * 0.001::DOUBLE + 0.5::DOUBLE) + 1) ELSE 0 END, 4) AS temperature FROM c""")
def calibrated_scenes(spark, sf):
    """Header texts to coefficients to calibrated pixels: the first band has no K1 and becomes reflectance, the second temperature."""
    px = demo.orders_raster(spark, sf).select(*KEY, "bands")
    k = F.substring("scene_id", 2, 18).cast("int")
    text = [F.concat(F.lit("SUN_ELEVATION = "), (30 + k % 40).cast("string"))]
    for tag, values in {"REFLECTANCE_MULT": ("0.00002", "0"), "REFLECTANCE_ADD": ("-0.1", "0"), "RADIANCE_MULT": ("1", "0.001"), "RADIANCE_ADD": ("0", "0.5"), "K1_CONSTANT": (None, "770")}.items():
        text += [F.lit(f"  {tag}_BAND_{b} = {v}") for b, v in enumerate(values, 1) if v is not None]
    text.append(F.concat(F.lit('K2_CONSTANT_BAND_2 = "'), (1300 + k % 7).cast("string"), F.lit('"')))
    headers = px.select("scene_id").distinct().select("scene_id", F.concat_ws("\n", *text).alias("text"))
    lines = catalog.header_lines(headers)
    out = align.calibrated(px, catalog.mtl_coefficients(lines), catalog.scalar_tag(lines, "SUN_ELEVATION", "sun"))
    return out.select(*KEY, F.round(F.get("bands", F.lit(0)), 6).alias("reflectance"), F.round(F.get("bands", F.lit(1)), 4).alias("temperature"))


@register("ras029_scene_label_rasters", f"""
WITH e AS (SELECT *, CAST(ts AS DATE) AS date, user_id * 4 AS x0 FROM events), s AS (SELECT event_id AS scene_id, date, x0, event_id % 20 AS y0 FROM e WHERE event_type NOT IN ('click', 'view')),
t AS (SELECT event_id AS label_id, date, x0, event_id * 7 % 20 AS y0 FROM e WHERE event_type IN ('click', 'view')),
m AS (SELECT scene_id, label_id, s.x0 AS sx, s.y0 AS sy, t.x0 AS tx, t.y0 AS ty FROM s JOIN t ON t.date = s.date
      AND t.x0 < s.x0 + 60 AND t.x0 + 12 > s.x0 AND t.y0 < s.y0 + 12 AND t.y0 + 8 > s.y0),
p AS (SELECT scene_id, label_id, gx.k AS gx, gy.k AS gy, label_id + (floor((sx + (gx.k + 0.5) * 4 - tx) / 2)::INT + floor((ty + 8 - (sy + 12 - (gy.k + 0.5) * 4)) / 2)::INT) AS label
      FROM m, range(15) gx(k), range(3) gy(k) WHERE sx + (gx.k + 0.5) * 4 >= tx AND sx + (gx.k + 0.5) * 4 < tx + 12 AND sy + 12 - (gy.k + 0.5) * 4 > ty AND sy + 12 - (gy.k + 0.5) * 4 <= ty + 8)
SELECT scene_id, count(*)::BIGINT AS covered, sum(label)::BIGINT AS total FROM (SELECT scene_id, gx, gy, arg_max(label, label_id) AS label FROM p GROUP BY scene_id, gx, gy) GROUP BY scene_id""")
def scene_label_rasters(spark, sf):
    """All label tiles of each scene's date and place, put together and resampled to the scene's grid; sums over the covered pixels.

    Scenes have 15 x 3 pixels of side 4, label tiles 6 x 4 of side 2 whose label is the tile's id plus column and row.
    """
    scenes, labels = demo.event_boxes(spark, sf)

    def gt(b: str, side: float):
        return F.array(F.col(f"{b}.min_x").cast("double"), F.lit(side), F.lit(0.0), F.col(f"{b}.max_y").cast("double"), F.lit(0.0), F.lit(-side))

    scenes = scenes.withColumns({"gt": gt("box", 4.0), "width": F.lit(15), "height": F.lit(3)})
    tiles = labels.withColumn("label_gt", gt("label_box", 2.0))
    px = labels.select("label_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y")).select("label_id", "y", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("x"))
    rows = catalog.scene_labels(scenes, tiles, px.withColumn("label", F.col("label_id") + F.col("x") + F.col("y")), 16)
    return rows.filter("label IS NOT NULL").groupBy("scene_id").agg(F.count(F.lit(1)).alias("covered"), F.sum("label").alias("total"))


def _scenes(spark, sf):
    """The orders' scenes, dealt over tasks: names are few bytes, from which many pixels are made."""
    scenes = demo.orders_raster(spark, sf).select("scene_id").distinct()
    return scenes.repartition(spark.sparkContext.defaultParallelism)


def _target(spark, sf, side):
    rows = _scenes(spark, sf).select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y"))
    return rows.select("scene_id", "y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"))


TARGET = "t AS (SELECT s.scene_id, y.k::INT AS y, x.k::INT AS x FROM (SELECT DISTINCT scene_id FROM px) s, range({0}) y(k), range({0}) x(k))"


@register("ras120_resample_nearest", f"WITH {demo.PX}, {TARGET.format(20)} SELECT t.scene_id, t.y, t.x, px.v FROM t LEFT JOIN px ON px.scene_id = t.scene_id AND px.y = floor((t.y + 0.5) * 2.75) AND px.x = floor((t.x + 0.5) * 2.75)")
def resample_nearest(spark, sf):
    t = _target(spark, sf, 20)
    out = align.resample_nearest(t, demo.orders_raster(spark, sf), (F.col("y") + 0.5) * 2.75, (F.col("x") + 0.5) * 2.75)
    return out.select(*KEY, F.get("bands", F.lit(0)).alias("v"))


@register("ras121_resample_bilinear", f"""
WITH {demo.PX}, {TARGET.format(20)}, n AS (SELECT *, (y + 0.5) * 2.25::DOUBLE - 0.5 AS fy, (x + 0.5) * 2.25::DOUBLE - 0.5 AS fx FROM t),
e AS (SELECT n.scene_id, n.y, n.x, floor(fy) + dy.k AS sy, floor(fx) + dx.k AS sx,
    (CASE dy.k WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE dx.k WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS w FROM n, range(2) dy(k), range(2) dx(k))
SELECT e.scene_id, e.y, e.x, round(sum(w * CASE WHEN label < 2 THEN v END) / sum(CASE WHEN label < 2 THEN w END), 3) AS v FROM e JOIN (SELECT scene_id, y AS sy, x AS sx, v, label FROM px) s USING (scene_id, sy, sx)
WHERE w > 0 GROUP BY ALL HAVING sum(CASE WHEN label < 2 THEN w END) > 0""".replace("SELECT scene_id, y AS sy, x AS sx, v, label FROM px", "SELECT scene_id, y AS sy, x AS sx, px.v, label FROM px"))
def resample_bilinear(spark, sf):
    """Labels of nodata are gaps."""
    px = demo.orders_raster(spark, sf)
    src = px.withColumn("bands", F.array(F.when(F.col("label") < demo.NODATA, F.get("bands", F.lit(0)))))
    out = align.resample_bilinear(_target(spark, sf, 20), src, (F.col("y") + 0.5) * 2.25, (F.col("x") + 0.5) * 2.25)
    return out.select(*KEY, F.round("value", 3).alias("v"))


@register("ras122_crop_or_pad", f"WITH {demo.PX}, t AS (SELECT s.scene_id, (y.k - 3)::INT AS y, (x.k + 40)::INT AS x FROM (SELECT DISTINCT scene_id FROM px) s, range(13) y(k), range(20) x(k)) SELECT t.*, px.v FROM t LEFT JOIN px USING (scene_id, y, x)")
def crop_or_pad(spark, sf):
    px = demo.orders_raster(spark, sf)
    boxes = _scenes(spark, sf).select("scene_id", F.lit(40).alias("min_x"), F.lit(-3).alias("min_y"), F.lit(60).alias("max_x"), F.lit(10).alias("max_y"))
    return align.onto_grid(px, boxes).select(*KEY, F.get("bands", F.lit(0)).alias("v"))


@register("ras125_height_above_ground", f"WITH {demo.PX} SELECT scene_id, y, x, v - w AS value FROM px")
def height_above_ground(spark, sf):
    px = demo.orders_raster(spark, sf)
    surface, ground = (px.select(*KEY, F.get("bands", F.lit(k)).alias("value")) for k in (0, 1))
    return align.height_above_ground(surface, ground)


@register("ras127_roughness", f"""
WITH {demo.PX}, g AS (SELECT scene_id, y, x, CASE WHEN label < 2 OR x > 25 THEN v END AS v FROM px)
SELECT a.scene_id, a.y, a.x, CASE WHEN count(b.v) = 9 THEN max(b.v) - min(b.v) END AS roughness FROM g a JOIN g b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY a.scene_id, a.y, a.x"))
def roughness(spark, sf):
    v = F.when((F.col("label") < demo.NODATA) | (F.col("x") > 25), F.get("bands", F.lit(0)))
    return align.roughness(demo.orders_raster(spark, sf).select(*KEY, v.alias("value")))


def _gappy(spark, sf):
    return demo.orders_raster(spark, sf).select(*KEY, F.when(F.col("label") < demo.NODATA, F.get("bands", F.lit(0))).alias("value"))


@register("ras124_fill_nodata", f"""
WITH {demo.PX}, g AS (SELECT scene_id, y, x, CASE WHEN label < 2 THEN px.v END AS v FROM px),
f AS (SELECT a.scene_id, a.y, a.x, sum(b.v / sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) / sum(1 / sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS v
      FROM g a JOIN g b ON a.scene_id = b.scene_id AND a.v IS NULL AND b.v IS NOT NULL AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 256 GROUP BY a.scene_id, a.y, a.x),
w AS (SELECT g.scene_id, g.y, g.x, coalesce(g.v, f.v) AS v, f.v IS NOT NULL AS filled FROM g LEFT JOIN f USING (scene_id, y, x)),
s AS (SELECT a.scene_id, a.y, a.x, avg(b.v) AS v FROM w a JOIN w b ON a.filled AND a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.scene_id, a.y, a.x)
SELECT w.scene_id, w.y, w.x, round(CASE WHEN w.filled THEN s.v ELSE w.v END, 2) AS value FROM w LEFT JOIN s USING (scene_id, y, x)""")
def fill_nodata(spark, sf):
    return scoring.fill_nodata(_gappy(spark, sf), tile=25).select(*KEY, F.round("value", 2).alias("value"))


@register("ras126_gaussian_blur", f"""
WITH {demo.PX}, k AS (SELECT k, exp(-0.5::DOUBLE * (k / 9.0::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (k / 9.0::DOUBLE) ** 2)) OVER () AS g FROM range(-36, 37) t(k)),
n AS (SELECT scene_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY scene_id),
e AS (SELECT px.scene_id, px.y, px.x, g, ((px.y + k) % (2 * h) + 2 * h) % (2 * h) AS s, h FROM px JOIN n USING (scene_id), k),
a AS (SELECT e.scene_id, e.y, e.x, sum(g * px.v) AS v FROM e JOIN px ON px.scene_id = e.scene_id AND px.x = e.x AND px.y = CASE WHEN s < h THEN s ELSE 2 * h - 1 - s END GROUP BY e.scene_id, e.y, e.x),
f AS (SELECT a.scene_id, a.y, a.x, g, ((a.x + k) % (2 * w) + 2 * w) % (2 * w) AS s, w FROM a JOIN n USING (scene_id), k)
SELECT f.scene_id, f.y, f.x, round(sum(g * a.v), 2) AS value FROM f JOIN a ON a.scene_id = f.scene_id AND a.y = f.y AND a.x = CASE WHEN s < w THEN s ELSE 2 * w - 1 - s END GROUP BY f.scene_id, f.y, f.x""")
def gaussian_blur(spark, sf):
    px = demo.orders_raster(spark, sf).select(*KEY, F.get("bands", F.lit(0)).alias("value"))
    return scoring.gaussian_blur(px, tile=25).select(*KEY, F.round("value", 2).alias("value"))


def _model(a):
    return (a[..., :1] * 0.25 + a[..., 1:2] * 2.0) if a.shape[-1] > 1 else a * 0.25 + 1.0


def _box_mean(a):
    """3 x 3 mean of the first band, valid part."""
    n = a.shape[1] - 2, a.shape[2] - 2
    return sum(a[:, dy : dy + n[0], dx : dx + n[1], :1] for dy in range(3) for dx in range(3)) / 9.0


def _order_blocks(spark, sf):
    """The orders' scenes as tiles of 16 x 16, and the scenes' sizes."""
    px = demo.orders_raster(spark, sf).select(*KEY, "bands")
    return grid.pixels_to_tiles(px, 16, 16), px.groupBy("scene_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _stored_blocks(spark, sf):
    """The same, written by rows of tiles and read again."""
    path = scratch(spark)
    files.write_tiles(demo.orders_raster(spark, sf).select(*KEY, "bands"), path, 16, by_row=True)
    blocks = spark.read.parquet(path)
    return blocks, blocks.groupBy("scene_id").agg(F.max("max_x").alias("width"), F.max("max_y").alias("height"))


@register("ras086_score_tiles", "SELECT vec_id::VARCHAR AS scene_id, (i // 8)::INT AS y, (i % 8)::INT AS x, round(embedding[i + 1]::DOUBLE * 0.25 + 1, 5) AS p FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)")
def score_tiles(spark, sf):
    px = scoring.stitch(scoring.score_tiles(demo.embedding_tiles(spark, sf), _model, patch=(4, 4)))
    return px.select(*KEY, F.round(F.get("probs", F.lit(0)), 5).alias("p"))


@register("ras087_stitch_owned", f"""
WITH {demo.PX} SELECT a.scene_id, a.y, a.x, round(avg(b.v), 4) AS p FROM px a JOIN px b ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
GROUP BY a.scene_id, a.y, a.x HAVING count(*) = 9""")
def stitch_owned(spark, sf):
    """A 3 x 3 mean over overlapping tiles, cut from tiles side by side; every output pixel comes from the tile that owns it."""
    tiles = windows.overlapping_tiles(*_order_blocks(spark, sf), (20, 20), (6, 6))
    return scoring.stitch(scoring.score_tiles(tiles, _box_mean)).select(*KEY, F.round(F.get("probs", F.lit(0)), 4).alias("p"))


@register("ras088_image_to_image", f"WITH {demo.PX}, h AS (SELECT scene_id, max(y) + 1 AS h FROM px GROUP BY scene_id) SELECT scene_id, y, x, round(v * 0.25 + w * 2, 4) AS p FROM px JOIN h USING (scene_id) WHERE h >= 25")
def image_to_image(spark, sf):
    """Tiles of 25 from blocks of 16; a scene less than a tile has no output."""
    tiles = windows.overlapping_tiles(*_order_blocks(spark, sf), (25, 25))
    return scoring.stitch(scoring.score_tiles(tiles, _model)).select(*KEY, F.round(F.get("probs", F.lit(0)), 4).alias("p"))


def _four(a):
    v, w = a[..., :1], a[..., 1:2]
    return np.concatenate([v, w, v + w, v - w], axis=-1)


@register("ras088_typed_outputs", f"""
WITH {demo.PX}, h AS (SELECT scene_id, max(y) + 1 AS h FROM px GROUP BY scene_id)
SELECT scene_id, y, x, CASE WHEN w = 7 THEN 0 ELSE floor(least(255, v / 500000 * 255)) END::SMALLINT AS first, CASE WHEN w = 7 THEN 0 ELSE floor(least(255, greatest(0, (v - w) / 500000 * 255))) END::SMALLINT AS second, 'smallint' AS kind
FROM px JOIN h USING (scene_id) WHERE h >= 20""")
def typed_outputs(spark, sf):
    """A byte image of two bands made of a model's four; pixels whose customer is 7 are nodata, and 0 in the image."""
    blocks, scenes = _order_blocks(spark, sf)
    # the band that tells nodata comes first in the tiles, and the model puts the bands back
    turned = blocks.withColumn("data", F.flatten(F.transform(F.sequence(F.lit(0), (F.size("data") / 2 - 1).cast("int")), lambda k: F.array(F.get("data", 2 * k + 1), F.get("data", 2 * k)))))
    tiles = windows.overlapping_tiles(turned, scenes, (20, 20), (4, 4))
    scored = scoring.score_tiles(tiles, lambda a: _four(a[..., ::-1]), nodata=7.0, transform=lambda out: np.clip(out[..., [0, 3]] / 500000 * 255, 0, 255), dtype="byte")
    kind = scored.schema["scores"].dataType.elementType.simpleString()
    return scoring.stitch(scored).select(*KEY, F.get("probs", F.lit(0)).alias("first"), F.get("probs", F.lit(1)).alias("second"), F.lit(kind).alias("kind"))


BOUNDS = (33, 10, 50, 30)


@register("ras089_score_in_bounds", f"""
WITH {demo.PX}, h AS (SELECT scene_id, max(y) + 1 AS h FROM px GROUP BY scene_id), s AS (SELECT scene_id, unnest([least(10, h - 12), least(18, h - 12)]) AS start, unnest([10, 20]) AS own0, unnest([20, 30]) AS own1 FROM h),
r AS (SELECT scene_id, greatest(own0, start + 1) AS y0, least(own1, start + 11) AS y1 FROM s WHERE start >= 0)
SELECT a.scene_id, a.y, a.x, round(avg(b.v), 4) AS p FROM px a JOIN r ON r.scene_id = a.scene_id AND a.y >= y0 AND a.y < y1 JOIN px b ON b.scene_id = a.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
WHERE a.x >= 34 AND a.x < 49 GROUP BY a.scene_id, a.y, a.x""")
def score_in_bounds(spark, sf):
    """A 3 x 3 mean inside bounds, over tiles of 12 that share 4: the last ones are moved back and read what lies before the
    bounds. Only blocks that a tile may reach are read, by folder."""
    blocks, scenes = _stored_blocks(spark, sf)
    tiles = windows.overlapping_tiles(blocks, scenes, (12, 12), (4, 4), bounds=BOUNDS, block=(16, 16))
    return scoring.stitch(scoring.score_tiles(tiles, _box_mean)).select(*KEY, F.round(F.get("probs", F.lit(0)), 4).alias("p"))


def order_shapes(spark, sf):
    """Two shapes for each scene, as WKT: a triangle tagged by the scene's parity, and an untagged square with a hole."""
    k = F.substring("scene_id", 2, 9).cast("int")
    scenes = demo.orders_raster(spark, sf).select("scene_id").distinct().withColumn("k", k)
    tri = F.format_string("POLYGON ((%d 5, 40.5 8, 20 %d, %d 5))", F.col("k") % 5 + 2, F.col("k") % 7 + 38, F.col("k") % 5 + 2)
    square = F.lit("MULTIPOLYGON (((10 10, 30 10, 30 30, 10 30, 10 10), (15 15, 25 15, 25 25, 15 25, 15 15)), ((44 44, 49 44, 49 49, 44 49, 44 44)))")
    one = scenes.select("scene_id", F.lit(1).cast("long").alias("shape_id"), tri.alias("wkt"), F.when(F.col("k") % 2 == 0, "urban, river").otherwise(" urban ").alias("tag_text"))
    two = scenes.select("scene_id", F.lit(2).cast("long").alias("shape_id"), square.alias("wkt"), F.lit("").alias("tag_text"))
    return one.unionByName(two).select("scene_id", "shape_id", regions.parse_tags(F.col("tag_text")).alias("tags"), regions.parse_wkt(F.col("wkt")).alias("rings"))


SHAPES = f"""{demo.PX}, s AS (SELECT DISTINCT scene_id, substr(scene_id, 2)::INT AS k FROM px),
edges AS (SELECT scene_id, 1 AS shape_id, 0 AS poly, e[1]::DOUBLE AS ax, e[2]::DOUBLE AS ay, e[3]::DOUBLE AS bx, e[4]::DOUBLE AS by_ FROM (SELECT scene_id, unnest([[k % 5 + 2, 5, 40.5, 8], [40.5, 8, 20, k % 7 + 38], [20, k % 7 + 38, k % 5 + 2, 5]]) AS e FROM s)
    UNION ALL SELECT scene_id, 2, e[5]::INT, e[1]::DOUBLE, e[2]::DOUBLE, e[3]::DOUBLE, e[4]::DOUBLE FROM (SELECT scene_id, unnest([[10, 10, 30, 10, 0], [30, 10, 30, 30, 0], [30, 30, 10, 30, 0], [10, 30, 10, 10, 0], [15, 15, 25, 15, 0], [25, 15, 25, 25, 0], [25, 25, 15, 25, 0], [15, 25, 15, 15, 0], [44, 44, 49, 44, 1], [49, 44, 49, 49, 1], [49, 49, 44, 49, 1], [44, 49, 44, 44, 1]]) AS e FROM s)),
held AS (SELECT DISTINCT scene_id, shape_id, y, x FROM (
    SELECT px.scene_id, shape_id, poly, y, x FROM px JOIN edges USING (scene_id)
    WHERE (ay > y + 0.5) <> (by_ > y + 0.5) AND x + 0.5 < (bx - ax) * (y + 0.5 - ay) / (by_ - ay) + ax GROUP BY px.scene_id, shape_id, poly, y, x HAVING count(*) % 2 = 1))"""


@register("ras008_region_shapes", f"""
WITH {demo.PX}, s AS (SELECT DISTINCT scene_id, substr(scene_id, 2)::INT AS k FROM px)
SELECT scene_id, 1::BIGINT AS shape_id, CASE WHEN k % 2 = 0 THEN 'urban|river' ELSE 'urban' END AS tags, 1 AS rings, 0 AS holes, 4 AS points FROM s UNION ALL SELECT scene_id, 2, '', 3, 1, 15 FROM s""")
def region_shapes(spark, sf):
    r = F.col("rings")
    points = F.aggregate(r, F.lit(0), lambda n, x: n + F.size(x["pts"]))
    return order_shapes(spark, sf).select("scene_id", "shape_id", F.array_join("tags", "|").alias("tags"), F.size(r).alias("rings"), F.size(F.filter(r, lambda x: x["hole"])).alias("holes"), points.alias("points"))


@register("ras045_shape_bounds", f"""
WITH {demo.PX}, s AS (SELECT DISTINCT scene_id, substr(scene_id, 2)::BIGINT AS k FROM px)
SELECT scene_id, 1::BIGINT AS shape_id, k % 5 + 2 AS min_x, 5::BIGINT AS min_y, 41::BIGINT AS max_x, k % 7 + 38 AS max_y FROM s UNION ALL SELECT scene_id, 2, 10, 10, 49, 49 FROM s""")
def shape_bounds(spark, sf):
    return order_shapes(spark, sf).select("scene_id", "shape_id", *flat("", regions.bounds(F.col("rings"))))


@register("ras091_shapes_to_pixels", f"""
WITH {demo.PX}, s AS (SELECT DISTINCT scene_id, substr(scene_id, 2)::INT AS k FROM px),
p AS (SELECT scene_id, 1::BIGINT AS shape_id, 0 AS ring, 0 AS poly, false AS hole, unnest(range(4))::INT AS position, unnest([[k % 5 + 2, 5], [40.5, 8], [20, k % 7 + 38], [k % 5 + 2, 5]]::DOUBLE[][]) AS q FROM s
    UNION ALL SELECT scene_id, 2, 0, 0, false, unnest(range(5))::INT, unnest([[10, 10], [30, 10], [30, 30], [10, 30], [10, 10]]::DOUBLE[][]) FROM s
    UNION ALL SELECT scene_id, 2, 1, 0, true, unnest(range(5))::INT, unnest([[15, 15], [25, 15], [25, 25], [15, 25], [15, 15]]::DOUBLE[][]) FROM s
    UNION ALL SELECT scene_id, 2, 2, 1, false, unnest(range(5))::INT, unnest([[44, 44], [49, 44], [49, 49], [44, 49], [44, 44]]::DOUBLE[][]) FROM s)
SELECT scene_id, shape_id, ring, poly, hole, position, (q[1] - 1.0::DOUBLE) / 0.5 AS x, (q[2] - 60.0::DOUBLE) / -0.25 AS y FROM p""")
def shapes_to_pixels(spark, sf):
    """All points of all rings; ``ring`` numbers the rings of a shape, ``position`` the points of a ring."""
    gt = F.array(*map(F.lit, (1.0, 0.5, 0.0, 60.0, 0.0, -0.25)))
    rings = order_shapes(spark, sf).select("scene_id", "shape_id", F.posexplode(regions.to_pixels(F.col("rings"), gt)).alias("ring", "r"))
    points = rings.select("scene_id", "shape_id", "ring", "r.poly", "r.hole", F.posexplode("r.pts").alias("position", "p"))
    return points.select("scene_id", "shape_id", "ring", "poly", "hole", "position", "p.x", "p.y")


PAINTED = """rings AS (SELECT scene_id, 1 AS shape_id, 0 AS ring, true AS fills, unnest([[k % 5 + 2, 5, 40.5, 8], [40.5, 8, 20, k % 7 + 38], [20, k % 7 + 38, k % 5 + 2, 5]])::DOUBLE[] AS e FROM s
    UNION ALL SELECT scene_id, 2, 0, true, unnest([[10, 10, 30, 10], [30, 10, 30, 30], [30, 30, 10, 30], [10, 30, 10, 10]])::DOUBLE[] FROM s
    UNION ALL SELECT scene_id, 2, 1, false, unnest([[15, 15, 25, 15], [25, 15, 25, 25], [25, 25, 15, 25], [15, 25, 15, 15]])::DOUBLE[] FROM s
    UNION ALL SELECT scene_id, 2, 2, true, unnest([[44, 44, 49, 44], [49, 44, 49, 49], [49, 49, 44, 49], [44, 49, 44, 44]])::DOUBLE[] FROM s
    UNION ALL SELECT scene_id, 3, 0, true, unnest([[18, 18, 22.5, 18], [22.5, 18, 22.5, 27], [22.5, 27, 18, 27], [18, 27, 18, 18]])::DOUBLE[] FROM s),
inside AS (SELECT px.scene_id, y, x, shape_id, ring, fills FROM px JOIN rings USING (scene_id) WHERE (e[2] > y + 0.5) <> (e[4] > y + 0.5) AND x + 0.5 < (e[3] - e[1]) * (y + 0.5 - e[2]) / (e[4] - e[2]) + e[1]
    GROUP BY px.scene_id, y, x, shape_id, ring, fills HAVING count(*) % 2 = 1),
painted AS (SELECT scene_id, y, x, arg_max(fills, shape_id * 10 + ring) AS held FROM inside {only} GROUP BY scene_id, y, x)"""


@register("ras090_mask_outside_shapes", f"WITH {SHAPES}, {PAINTED.format(only='WHERE shape_id < 3')} SELECT px.scene_id, px.y, px.x, CASE WHEN held THEN label ELSE 2 END AS label FROM px LEFT JOIN painted USING (scene_id, y, x)")
def mask_outside_shapes(spark, sf):
    """The square's hole clears the triangle's part of it, too: shapes are painted in order."""
    px = demo.orders_raster(spark, sf).select(*KEY, "label")
    return regions.mask_outside(px, order_shapes(spark, sf), "label", demo.NODATA, demo.SIDE, demo.SIDE)


@register("ras090_painted_shape_files", f"""
WITH {SHAPES}, {PAINTED.format(only='')}, named AS (SELECT px.scene_id, label, (v / 500000 >= 0.5)::INT AS pred, held, substr(px.scene_id, 2)::INT % 3 = 2 AS bare FROM px LEFT JOIN painted USING (scene_id, y, x))
SELECT scene_id, count(*) FILTER (label < 2 AND (held OR bare)) AS pixels, count(*) FILTER (label < 2 AND (held OR bare) AND label = pred) AS hits FROM named GROUP BY scene_id""")
def painted_shape_files(spark, sf):
    """Shapes in a file for each image, found by its path: a hole over an earlier shape, and a later shape that fills a part of
    it again. Every third image has no file and stays as it is. Geo coordinates become pixels by the image's geotransform."""
    root = scratch(spark)
    px = demo.orders_raster(spark, sf).select(*KEY, "label", (demo.probability() >= 0.5).cast("int").alias("pred"))
    images = px.select("scene_id").distinct().withColumns({"path": F.concat(F.lit("in/deep/"), "scene_id", F.lit(".tiff")), "k": F.substring("scene_id", 2, 9).cast("int")})
    tri = F.format_string("POLYGON ((%d 195, 140.5 192, 120 %d, %d 195))", F.col("k") % 5 + 102, 162 - F.col("k") % 7, F.col("k") % 5 + 102)
    square = "MULTIPOLYGON (((110 190, 130 190, 130 170, 110 170, 110 190), (115 185, 125 185, 125 175, 115 175, 115 185)), ((144 156, 149 156, 149 151, 144 151, 144 156)))"
    again = "POLYGON ((118 182, 122.5 182, 122.5 173, 118 173, 118 182))"
    text = F.concat(F.lit('# WKT, region\n"'), tri, F.lit(f'",urban\n"{square}",\n"{again}"," river, urban"\n"POINT (1 1)",x\n'))
    made = images.filter("k % 3 <> 2").select(files.shapes_path(F.col("path"), "regions").alias("path"), F.encode(text, "utf-8").alias("content"))
    files.write_files(made, root).write.format("noop").mode("overwrite").save()
    gt = F.array(*map(F.lit, (100.0, 1.0, 0.0, 200.0, 0.0, -1.0)))
    shapes = files.read_shapes(spark, root).withColumn("rings", regions.to_pixels(F.col("rings"), gt))
    masked = regions.mask_outside(px, shapes, "label", demo.NODATA, demo.SIDE, demo.SIDE, keep_unshaped=True)
    good = F.col("label") != demo.NODATA
    return masked.groupBy("scene_id").agg(F.count(F.when(good, 1)).alias("pixels"), F.count(F.when(good & (F.col("label") == F.col("pred")), 1)).alias("hits"))


@register("ras123_clip_to_cutline", f"WITH {SHAPES} SELECT px.scene_id, px.y, px.x, CASE WHEN h.y IS NOT NULL THEN v END AS v FROM px LEFT JOIN held h ON h.shape_id = 1 AND h.scene_id = px.scene_id AND h.y = px.y AND h.x = px.x")
def clip_to_cutline(spark, sf):
    px = demo.orders_raster(spark, sf).select(*KEY, F.get("bands", F.lit(0)).alias("v"))
    return regions.mask_outside(px, order_shapes(spark, sf).filter("shape_id = 1"), "v", None, demo.SIDE, demo.SIDE)


@register("ras098_region_confusion", f"""
WITH {SHAPES}, q AS (SELECT *, (v / 500000 >= 0.5)::INT AS pred FROM px),
named AS (SELECT *, 'all' AS region FROM q UNION ALL SELECT q.*, 'urban' FROM q JOIN held h USING (scene_id, y, x) WHERE h.shape_id = 1
    UNION ALL SELECT q.*, 'river' FROM q JOIN held h USING (scene_id, y, x) WHERE h.shape_id = 1 AND substr(scene_id, 2)::INT % 2 = 0
    UNION ALL SELECT q.*, 'shape 2' FROM q JOIN held h USING (scene_id, y, x) WHERE h.shape_id = 2),
cells AS (SELECT region, scene_id, t.k::INT AS true_class, d.k::INT AS pred_class FROM (SELECT DISTINCT region, scene_id FROM named WHERE label < 2), range(2) t(k), range(2) d(k)),
conf AS (SELECT c.region, c.scene_id, c.true_class, c.pred_class, count(n.label) AS n FROM cells c LEFT JOIN named n ON n.region = c.region AND n.scene_id = c.scene_id AND n.label = c.true_class AND n.pred = c.pred_class
    GROUP BY c.region, c.scene_id, c.true_class, c.pred_class)
SELECT * FROM conf UNION ALL SELECT region, NULL, true_class, pred_class, sum(n)::BIGINT FROM conf GROUP BY region, true_class, pred_class""")
def region_confusion(spark, sf):
    px = demo.orders_raster(spark, sf).select(*KEY, "label", (demo.probability() >= 0.5).cast("int").alias("pred"))
    return regions.region_confusion(px, order_shapes(spark, sf), ["urban", "river"], demo.SIDE, demo.SIDE, "label", "pred", 2, demo.NODATA)
