"""Queries over boxes and tile grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import grid
from . import demo

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def flat(prefix: str, b: Column) -> list[Column]:
    return [b[s].alias(prefix + s) for s in G.SIDES]


def _grid_sql(tile, overlap, partials=True, least=(0, 0), shift_back=False, container="0, 0, width, height") -> str:
    (tw, th), (ox, oy) = tile, overlap
    sx, sy = tw - ox, th - oy
    up = f"ceil((width - {ox}) / {sx}.0)::INT", f"ceil((height - {oy}) / {sy}.0)::INT"
    if not (partials or shift_back):
        up = f"least({up[0]}, floor((cx1 - cx0 - {ox}) / {sx}.0)::INT)", f"least({up[1]}, floor((cy1 - cy0 - {oy}) / {sy}.0)::INT)"
    x, y = f"tile_col * {sx}", f"tile_row * {sy}"
    if partials:
        box = f"{x} AS min_x, {y} AS min_y, least({x} + {tw}, width) AS max_x, least({y} + {th}, height) AS max_y"
        keep = f"max_x - min_x >= {least[0]} AND max_y - min_y >= {least[1]}"
    else:
        right, low = (f"least({x} + {tw}, cx1)", f"least({y} + {th}, cy1)") if shift_back else (f"{x} + {tw}", f"{y} + {th}")
        box = f"{right} - {tw} AS min_x, {low} - {th} AS min_y, {right} AS max_x, {low} AS max_y"
        keep = "min_x >= cx0 AND min_y >= cy0 AND max_x <= cx1 AND max_y <= cy1"
    return f"""
WITH {demo.SCENES}, c AS (SELECT *, c[1] AS cx0, c[2] AS cy0, c[3] AS cx1, c[4] AS cy1 FROM (SELECT *, [{container}] AS c FROM scenes)),
n AS (SELECT *, {up[0]} AS nx, {up[1]} AS ny FROM c),
t AS (SELECT *, unnest(range(nx)) AS tile_col FROM (SELECT *, unnest(range(ny)) AS tile_row FROM n WHERE nx > 0 AND ny > 0)),
g AS (SELECT scene_id, tile_row, tile_col, cx0, cy0, cx1, cy1, {box},
    greatest({x} + CASE WHEN tile_col > 0 THEN {ox // 2} ELSE 0 END, 0) AS v_min_x, greatest({y} + CASE WHEN tile_row > 0 THEN {oy // 2} ELSE 0 END, 0) AS v_min_y,
    least({x} + {tw} - CASE WHEN tile_col < nx - 1 THEN {ox // 2} ELSE 0 END, width) AS v_max_x, least({y} + {th} - CASE WHEN tile_row < ny - 1 THEN {oy // 2} ELSE 0 END, height) AS v_max_y FROM t)
SELECT scene_id, tile_row::INT AS tile_row, tile_col::INT AS tile_col, min_x::INT AS min_x, min_y::INT AS min_y, max_x::INT AS max_x, max_y::INT AS max_y,
    v_min_x::INT AS v_min_x, v_min_y::INT AS v_min_y, v_max_x::INT AS v_max_x, v_max_y::INT AS v_max_y FROM g WHERE {keep}"""


def _flat_grid(g):
    return g.select("scene_id", "tile_row", "tile_col", *flat("", F.col("tile")), *flat("v_", F.col("valid")))


GRIDS = {
    "ras032_tile_grid": {"tile": (16, 12), "overlap": (0, 0)},
    "ras033_whole_tiles": {"tile": (16, 12), "overlap": (0, 0), "partials": False},
    "ras034_partial_tiles_least_size": {"tile": (16, 12), "overlap": (4, 2), "least": (9, 7)},
    "ras035_tiles_shifted_back": {"tile": (16, 12), "overlap": (4, 2), "partials": False, "shift_back": True},
    "ras036_owner_boxes_odd_overlap": {"tile": (16, 12), "overlap": (5, 3)},
}
for _name, _args in GRIDS.items():
    QUERIES[_name] = lambda spark, sf, a=_args: _flat_grid(grid.make_tile_grid(demo.supplier_scenes(spark, sf), **a))
    SQL[_name] = _grid_sql(**_args)
SQL["ras033_whole_tiles_in_container"] = _grid_sql((16, 12), (0, 0), partials=False, container="0, 0, width + 10, height + 10")


@register("ras033_whole_tiles_in_container")
def whole_tiles_in_container(spark, sf):
    around = G.box(F.lit(0), F.lit(0), F.col("width") + 10, F.col("height") + 10)
    return _flat_grid(grid.make_tile_grid(demo.supplier_scenes(spark, sf), (16, 12), partials=False, container=around))


@register("ras037_row_blocks", f"""
WITH g AS ({_grid_sql((16, 12), (4, 2))})
SELECT scene_id, tile_row, tile_col, min(min_x) OVER b AS b_min_x, min(min_y) OVER b AS b_min_y, max(max_x) OVER b AS b_max_x, max(max_y) OVER b AS b_max_y,
    min_x - min(min_x) OVER b AS min_x, min_y - min(min_y) OVER b AS min_y, max_x - min(min_x) OVER b AS max_x, max_y - min(min_y) OVER b AS max_y
FROM g WINDOW b AS (PARTITION BY scene_id, tile_row)""")
def row_blocks(spark, sf):
    rows = grid.group_by_row_block(grid.make_tile_grid(demo.supplier_scenes(spark, sf), (16, 12), (4, 2)))
    rows = rows.select("scene_id", "tile_row", "block", F.explode("tiles").alias("t"))
    return rows.select("scene_id", "tile_row", "t.tile_col", *flat("b_", F.col("block")), *flat("", F.col("t.tile")))


@register("ras038_tile_grid_yx", _grid_sql((16, 12), (4, 2), least=(9, 7)))
def tile_grid_yx(spark, sf):
    return _flat_grid(grid.make_tile_grid_yx(demo.supplier_scenes(spark, sf), (12, 16), (2, 4), least=(7, 9)))


@register("ras030_tiles_to_pixels", "SELECT vec_id::VARCHAR AS scene_id, (i // 8)::INT AS y, (i % 8)::INT AS x, embedding[i + 1]::DOUBLE AS value FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)")
def tiles_to_pixels(spark, sf):
    px = grid.tiles_to_pixels(demo.embedding_tiles(spark, sf))
    return px.select("scene_id", "y", "x", F.get("bands", F.lit(0)).cast("double").alias("value"))


@register("ras031_pixels_to_tiles", f"""
WITH {demo.PX}
SELECT scene_id, (y // 16)::INT AS tile_row, (x // 16)::INT AS tile_col, min(x) AS min_x, min(y) AS min_y, max(x) + 1 AS max_x, max(y) + 1 AS max_y,
    (2 * count(*))::BIGINT AS n_values, string_agg((v::BIGINT)::VARCHAR || ',' || (w::BIGINT)::VARCHAR, ',' ORDER BY y, x) AS data FROM (SELECT scene_id, y, x, floor(v) AS v, w FROM px) GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY scene_id, y // 16, x // 16"))
def pixels_to_tiles(spark, sf):
    t = grid.pixels_to_tiles(demo.orders_raster(spark, sf), 16, 16)
    text = F.array_join(F.transform("data", lambda v: F.floor(v).cast("string")), ",")
    return t.select("scene_id", "tile_row", "tile_col", "min_x", "min_y", "max_x", "max_y", F.size("data").cast("long").alias("n_values"), text.alias("data"))


@register("ras039_snap_to_blocks", f"""
WITH {demo.BOXES}, {demo.SCENES}, b AS (SELECT id, x0 % 40 AS x0, y0, x0 % 40 + (x1 - x0) AS x1, y1, width, height FROM boxes JOIN scenes ON scene_id = id % (SELECT count(*) FROM scenes))
SELECT id, CASE WHEN ok THEN greatest((x0 // 16) * 16, 0) END AS min_x, CASE WHEN ok THEN greatest((y0 // 8) * 8, 0) END AS min_y,
    CASE WHEN ok THEN least(((x1 - 1) // 16 + 1) * 16, width) END AS max_x, CASE WHEN ok THEN least(((y1 - 1) // 8 + 1) * 8, height) END AS max_y
FROM (SELECT *, x1 <= width AND y1 <= height AS ok FROM b)""")
def snap_to_blocks(spark, sf):
    scenes = demo.supplier_scenes(spark, sf)
    n = scenes.count()
    b = demo.customer_boxes(spark, sf).withColumn("scene_id", F.col("id") % n).join(scenes, "scene_id")
    x = F.col("box.min_x") % 40
    region = G.box(x, F.col("box.min_y"), x + G.width(F.col("box")), F.col("box.max_y"))
    return b.select("id", *flat("", G.snap_to_blocks(region, G.box(F.lit(0), F.lit(0), F.col("width"), F.col("height")), 16, 8)))


@register("ras040_box_measures", f"WITH {demo.BOXES} SELECT id, x1 - x0 AS width, y1 - y0 AS height, 2 * (x1 - x0) + 2 * (y1 - y0) AS perimeter, CASE WHEN y1 - 5 > y0 THEN (x1 - x0) * (y1 - 5 - y0) ELSE 0 END AS area, y1 - 5 > y0 AS has_area FROM boxes")
def box_measures(spark, sf):
    b = F.col("box")
    low = G.expand(b, F.lit(0), F.lit(0), F.lit(0), F.lit(-5))
    return demo.customer_boxes(spark, sf).select("id", G.width(b).alias("width"), G.height(b).alias("height"), G.perimeter(b).alias("perimeter"), G.area(low).alias("area"), G.has_area(low).alias("has_area"))


@register("ras041_box_moves", f"""
WITH {demo.BOXES} SELECT id, x0 + 3 AS s_min_x, y0 - 2 AS s_min_y, x1 + 3 AS s_max_x, y1 - 2 AS s_max_y, x0 * 2 AS k_min_x, y0 * 2 AS k_min_y, x1 * 2 AS k_max_x, y1 * 2 AS k_max_y,
    x0 - 1 AS e_min_x, y0 - 4 AS e_min_y, x1 + 1 AS e_max_x, y1 + 6 AS e_max_y FROM boxes""")
def box_moves(spark, sf):
    b = F.col("box")
    return demo.customer_boxes(spark, sf).select("id", *flat("s_", G.shift(b, F.lit(3), F.lit(-2))), *flat("k_", G.scale(b, F.lit(2))), *flat("e_", G.expand(b, F.lit(1), F.lit(4), up=F.lit(6))))


PAIRS = f"{demo.BOXES}, pairs AS (SELECT a.*, b.x0 AS u0, b.y0 AS w0, b.x1 AS u1, b.y1 AS w1 FROM boxes a JOIN boxes b ON b.id = a.id + 27)"


def _pairs(spark, sf):
    boxes = demo.customer_boxes(spark, sf)
    return boxes.join(boxes.select((F.col("id") - 27).alias("id"), F.col("box").alias("other")), "id")


@register("ras042_intersection", f"WITH {PAIRS} SELECT id, greatest(x0, u0) AS min_x, greatest(y0, w0) AS min_y, least(x1, u1) AS max_x, least(y1, w1) AS max_y FROM pairs")
def intersection(spark, sf):
    return _pairs(spark, sf).select("id", *flat("", G.intersection(F.col("box"), F.col("other"))))


@register("ras043_containment", f"""
WITH {PAIRS} SELECT id, u0 BETWEEN x0 AND x1 AND w0 BETWEEN y0 AND y1 AS has_corner, u0 >= x0 AND u1 <= x1 AND w0 >= y0 AND w1 <= y1 AS has_box,
    least(x1, u1) > greatest(x0, u0) AND least(y1, w1) > greatest(y0, w0) AS overlaps FROM pairs""")
def containment(spark, sf):
    a, b = F.col("box"), F.col("other")
    return _pairs(spark, sf).select("id", G.contains_point(a, b["min_x"], b["min_y"]).alias("has_corner"), G.contains_box(a, b).alias("has_box"), G.overlaps(a, b).alias("overlaps"))


@register("ras044_bounding_boxes", f"""
WITH {demo.BOXES} SELECT id % 100 AS part, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y,
    min(x1) AS p_min_x, min(y1) AS p_min_y, max(x1) + 1 AS p_max_x, max(y1) + 1 AS p_max_y, min(x0) / 4 AS f_min_x, max(x0) / 4 + 0.001::DOUBLE AS f_max_x FROM boxes GROUP BY id % 100""")
def bounding_boxes(spark, sf):
    """Of boxes, of whole-number points (their far corners) and of others."""
    rows = demo.customer_boxes(spark, sf).withColumn("part", F.col("id") % 100)
    corners = rows.select("part", F.col("box.max_x").alias("x"), F.col("box.max_y").alias("y"), (F.col("box.min_x") / 4).alias("u"), (F.col("box.min_y") / 4).alias("v"))
    boxes = grid.bounding_box(rows, F.col("box"), "part").select("part", *flat("", F.col("box")))
    points = grid.box_with_points(corners, "x", "y", "part").select("part", *flat("p_", F.col("box")))
    floats = grid.box_with_points(corners, "u", "v", "part").select("part", F.col("box.min_x").alias("f_min_x"), F.col("box.max_x").alias("f_max_x"))
    return boxes.join(points, "part").join(floats, "part")


@register("ras046_box_overlap_join", f"""
WITH {demo.BOXES} SELECT a.id AS left_id, b.id AS right_id FROM boxes a JOIN boxes b ON a.id < b.id
    AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)""")
def box_overlap_join(spark, sf):
    """Every two boxes that overlap, once, the lower id left."""
    boxes = demo.customer_boxes(spark, sf)
    left = boxes.select(F.col("id").alias("left_id"), F.col("box").alias("left_box"))
    right = boxes.select(F.col("id").alias("right_id"), F.col("box").alias("right_box"))
    return grid.box_overlap_join(left, right, "left_box", "right_box", 16).filter("left_id < right_id").select("left_id", "right_id")


@register("ras047_pixels_in_tiles", f"""
WITH {demo.PX}, t AS (SELECT unnest(range(4)) AS k)
SELECT scene_id, y, x, r.k::INT AS tile_row, c.k::INT AS tile_col,
    x >= c.k * 14 + CASE WHEN c.k > 0 THEN 2 ELSE 0 END AND x < c.k * 14 + 18 - CASE WHEN c.k < 3 THEN 2 ELSE 0 END
    AND y >= r.k * 14 + CASE WHEN r.k > 0 THEN 2 ELSE 0 END AND y < r.k * 14 + 18 - CASE WHEN r.k < 3 THEN 2 ELSE 0 END AS owned
FROM px JOIN t r ON y >= r.k * 14 AND y < r.k * 14 + 18 JOIN t c ON x >= c.k * 14 AND x < c.k * 14 + 18""")
def pixels_in_tiles(spark, sf):
    px = demo.orders_raster(spark, sf).select("scene_id", "y", "x")
    return grid.covering_tiles(px, 18, 4, F.lit(demo.SIDE), F.lit(demo.SIDE))


@register("ras048_pixel_geo", f"""
WITH {demo.SCENES} SELECT scene_id, gx + width * 0.5 AS far_x, gy - height * 0.25 AS far_y, trunc((40.3 - gx) / 0.5)::BIGINT AS px, trunc((99.9 - gy) / -0.25)::BIGINT AS py FROM scenes""")
def pixel_geo(spark, sf):
    g = F.col("gt")
    there, here = G.pixel_to_geo(g, F.col("width"), F.col("height")), G.geo_to_pixel(g, F.lit(40.3), F.lit(99.9))
    return demo.supplier_scenes(spark, sf).select("scene_id", there["gx"].alias("far_x"), there["gy"].alias("far_y"), here["x"].alias("px"), here["y"].alias("py"))


@register("ras049_footprints", f"WITH {demo.SCENES} SELECT scene_id, gx AS min_x, gy - height * 0.25 AS min_y, gx + width * 0.5 AS max_x, gy AS max_y, 0.5::DOUBLE AS pixel_x, 0.25::DOUBLE AS pixel_y FROM scenes")
def footprints(spark, sf):
    g = F.col("gt")
    return demo.supplier_scenes(spark, sf).select("scene_id", *flat("", G.footprint(g, F.col("width"), F.col("height"))), F.abs(g[1]).alias("pixel_x"), F.abs(g[5]).alias("pixel_y"))
