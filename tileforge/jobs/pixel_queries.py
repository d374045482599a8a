"""Queries over pixel expressions and class codes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import classes as C
from ..operators import grid, sampling
from . import demo

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = ["scene_id", "y", "x"]


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def V():
    return F.get("bands", F.lit(0))


def W():
    return F.get("bands", F.lit(1))


def bands(name: str, expression, sql_v: str, sql_w: str) -> None:
    """A query that applies an expression to both bands of the orders raster."""

    def run(spark, sf):
        px = demo.orders_raster(spark, sf).withColumn("bands", expression(F.col("bands")))
        return px.select(*KEY, F.round(V(), 6).alias("v"), F.round(W(), 6).alias("w"))

    QUERIES[name] = run
    SQL[name] = f"WITH {demo.PX} SELECT scene_id, y, x, round({sql_v}, 6) AS v, round({sql_w}, 6) AS w FROM px"


bands("ras050_scale", lambda b: P.scale(b, image_type="landsat"), "v / 120", "w / 120")
bands("ras051_offset", lambda b: P.offset(b, 2.5), "v + 2.5", "w + 2.5")
bands("ras052_clip", lambda b: P.clip(b, (1000, 200000)), "greatest(1000, least(200000, v))", "greatest(1000, least(200000, w))")
bands("ras053_roots", lambda b: P.cbrt(P.sqrt(b)), "cbrt(sqrt(v))", "cbrt(sqrt(w))")
bands("ras056_chain", lambda b: P.chain(b, [{"scale": {"factor": 2}}, {"offset": {"factor": 1}}, {"clip": {"bounds": (0, 90000)}}]), "greatest(0, least(90000, v / 2 + 1))", "greatest(0, least(90000, w / 2 + 1))")


def _u(i, c):
    return f"(('0x' || substr(md5('7:' || scene_id || ':' || y || ':' || x || ':{i}:{c}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _noise(v, i):
    return f"{v} * (1 + 0.1::DOUBLE * sqrt(-2 * ln(1 - {_u(i, 'u')})) * cos({2 * math.pi!r}::DOUBLE * {_u(i, 'v')}))"


@register("ras054_noise", f"WITH {demo.PX} SELECT scene_id, y, x, round({_noise('v', 0)}, 3) AS v, round({_noise('w', 1)}, 3) AS w FROM px")
def noise(spark, sf):
    px = demo.orders_raster(spark, sf)
    px = px.withColumn("bands", P.gauss_mult_noise(F.col("bands"), 0.1, 7, F.col("scene_id"), F.col("y"), F.col("x")))
    return px.select(*KEY, F.round(V(), 3).alias("v"), F.round(W(), 3).alias("w"))


@register("ras055_substitute", f"WITH {demo.PX} SELECT scene_id, y, x, [10, 20, 30, 40][priority + 1] AS code, [1, 0, 0][label + 1] AS hot0, [0, 1, 0][label + 1] AS hot1 FROM px")
def substitute(spark, sf):
    hot = P.substitute(F.col("label"), [[1, 0], [0, 1], [0, 0]])
    return demo.orders_raster(spark, sf).select(*KEY, P.substitute(F.col("priority"), [10, 20, 30, 40]).alias("code"), F.get(hot, F.lit(0)).alias("hot0"), F.get(hot, F.lit(1)).alias("hot1"))


CLASSES = {5: {"name": "five"}, 1: {"name": "one"}, 2: {"name": "two"}, 0: {"name": "zero"}}


@register("ras057_class_index", f"WITH {demo.PX}, c AS (SELECT *, CASE priority WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE priority END AS code FROM px) SELECT scene_id, y, x, CASE code WHEN 5 THEN 3 ELSE code END AS idx, code AS back FROM c")
def class_index(spark, sf):
    px = demo.orders_raster(spark, sf).withColumn("code", F.when(F.col("priority") == 3, 5).when(F.col("priority") == 4, 9).otherwise(F.col("priority")))
    classes = C.class_table(spark, CLASSES)
    return C.to_value(C.to_index(px, classes, "code", "idx"), classes, "idx", "back").select(*KEY, "idx", "back")


@register("ras058_label_nodata", f"WITH {demo.PX} SELECT scene_id, y, x, CASE priority WHEN 4 THEN 4 WHEN 3 THEN 3 ELSE priority END AS label FROM px")
def label_nodata(spark, sf):
    px = demo.orders_raster(spark, sf).withColumn("code", F.when(F.col("priority") == 3, 5).when(F.col("priority") == 4, 255).otherwise(F.col("priority")))
    px = C.to_index(px, C.class_table(spark, CLASSES), "code", "idx")
    return px.select(*KEY, C.with_nodata_index(F.col("idx"), F.col("code"), 255, len(CLASSES)).alias("label"))


@register("ras059_class_weights", f"WITH {demo.PX} SELECT scene_id, y, x, [1.5, 0.5, 0.0]::DOUBLE[][label + 1] AS weight FROM px".replace("[1.5, 0.5, 0.0]::DOUBLE[][label + 1]", "(CASE label WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 0 END)::DOUBLE"))
def class_weights(spark, sf):
    return demo.orders_raster(spark, sf).select(*KEY, C.class_weights(F.col("label"), [1.5, 0.5]).alias("weight"))


@register("ras129_class_table", """
SELECT (row_number() OVER (ORDER BY value) - 1)::INT AS idx, value, 'Class ' || value AS name,
    coalesce([2062260, 16744206, 2924588, 14034728, 9725885, 9197131, 14907330, 8355711, 12369186, 1556175][row_number() OVER (ORDER BY value)], 0) AS color
FROM (SELECT DISTINCT p_size AS value FROM part)""")
def class_table(spark, sf):
    return C.class_table_from_values(demo.table(spark, sf, "part"), "p_size")




def _toa(name, expression, value_sql):
    """``value_sql`` uses v (the band's value) and c0..c3, the band's constants."""

    def run(spark, sf):
        obs = demo.line_observations(spark, sf).withColumn("toa", expression())
        return obs.groupBy("scene_id").agg(*[F.round(F.sum(F.get("toa", F.lit(k))), 3).alias(f"band{k}") for k in range(4)])

    QUERIES[name] = run
    columns = []
    for k, v in enumerate(("l_quantity", "l_extendedprice", "nullif(l_discount, 0)", "l_tax")):
        q = value_sql.replace("{v}", v)
        for c in range(4):
            q = q.replace(f"{{c{c}}}", f"((l_suppkey % 7 + {k + 1} + {c}) / 10.0::DOUBLE)")
        columns.append(f"round(sum(CASE WHEN {v} > 0 THEN {q} ELSE 0 END), 3) AS band{k}")
    SQL[name] = f"SELECT l_suppkey AS scene_id, {', '.join(columns)} FROM lineitem GROUP BY l_suppkey"


def _c(k):
    def constant(b):
        return (F.col("scene_id") % 7 + b + k) / 10.0

    return F.transform(F.array(*map(F.lit, range(1, 5))), constant)


_toa("ras060_toa_radiance", lambda: P.toa_radiance(F.col("bands"), _c(0), _c(1)), "{v} * {c0} + {c1}")
_toa("ras061_toa_temperature", lambda: P.toa_temperature(F.col("bands"), _c(0), _c(1), _c(2), _c(3)), "{c3} / ln({c2} / ({v} * {c0} + {c1}) + 1)")
_toa("ras062_toa_reflectance", lambda: P.toa_reflectance(F.col("bands"), _c(0), _c(1), 10.0 + F.col("scene_id") % 50), "({v} * {c0} + {c1}) / sin(radians(10.0::DOUBLE + l_suppkey % 50))")
_toa("ras063_toa_worldview", lambda: P.toa_worldview(F.col("bands"), _c(0), _c(1)), "{v} * {c0} / {c1}")


@register("ras064_nodata_mask", f"WITH {demo.PX} SELECT scene_id, y, x, CASE WHEN w % 10 <> 3 THEN v / 500000 END AS p FROM px")
def nodata_mask(spark, sf):
    px = demo.orders_raster(spark, sf)
    marked = F.array(F.when(W() % 10 == 3, F.lit(-1.0)).otherwise(V()))
    return px.select(*KEY, P.mask_nodata(demo.probability(), marked, -1.0).alias("p"))


@register("ras065_decide_class", f"WITH {demo.SCORES} SELECT vec_id, list_position(probs, list_max(probs)) - 1 AS cls, (probs[1] >= 0.1)::INT AS binary_cls FROM scores")
def decide_class(spark, sf):
    return demo.class_scores(spark, sf).select("vec_id", P.decide(F.col("probs")).alias("cls"), P.decide(F.col("probs"), binary=True, threshold=0.1).alias("binary_cls"))


PY = f"WITH {demo.PX}, q AS (SELECT *, CASE WHEN label < 2 THEN v / 500000 END AS p FROM px)"


def _scored(spark, sf):
    return demo.orders_raster(spark, sf).withColumn("p", F.when(F.col("label") < demo.NODATA, demo.probability()))


@register("ras066_probability_byte", f"{PY} SELECT scene_id, y, x, coalesce(1 + least(254, greatest(0, floor(p * 254))), 0)::SMALLINT AS byte FROM q")
def probability_byte(spark, sf):
    return _scored(spark, sf).select(*KEY, P.probability_byte(F.col("p")).alias("byte"))


@register("ras067_error_byte", f"{PY} SELECT scene_id, y, x, coalesce(least(255, greatest(1, floor((p - label) * 127 + 128))), 0)::SMALLINT AS byte FROM q")
def error_byte(spark, sf):
    return _scored(spark, sf).select(*KEY, P.error_byte(F.col("p"), F.col("label")).alias("byte"))


@register("ras068_absolute_error_byte", f"{PY} SELECT scene_id, y, x, coalesce(least(255, greatest(1, floor(abs(p - label) * 254 + 1))), 0)::SMALLINT AS byte FROM q")
def absolute_error_byte(spark, sf):
    return _scored(spark, sf).select(*KEY, P.absolute_error_byte(F.col("p"), F.col("label")).alias("byte"))


@register("ras069_class_sink", f"{PY} SELECT scene_id, y, x, coalesce((p >= 0.5)::INT, -1) AS cls FROM q")
def class_sink(spark, sf):
    return _scored(spark, sf).select(*KEY, P.class_sink(P.decide(F.array("p"), binary=True)).alias("cls"))


SHADES = [sum(c >> s & 255 for s in (16, 8, 0)) for c in C.PALETTE]


@register("ras070_colours", f"""
WITH {demo.SCORES}, c AS (SELECT *, {[c for c in C.PALETTE]} AS palette FROM scores)
SELECT vec_id, (palette[label + 1] >> 16) & 255 AS r, (palette[label + 1] >> 8) & 255 AS g, palette[label + 1] & 255 AS b,
    floor(list_sum(list_transform(range(1, 11), lambda i: probs[i] * ((palette[i] >> 16) & 255))))::INT AS mixed_r,
    floor(list_sum(list_transform(range(1, 11), lambda i: probs[i] * (palette[i] & 255))))::INT AS mixed_b
FROM c""")
def colours(spark, sf):
    rgb = P.unpack_colour(P.class_colour(F.col("label"), list(C.PALETTE)))
    mixed = P.blend_colours(F.col("probs"), list(C.PALETTE))
    return demo.class_scores(spark, sf).select("vec_id", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"), mixed["r"].alias("mixed_r"), mixed["b"].alias("mixed_b"))


@register("ras071_rgb_stretch", f"""
WITH {demo.SCORES} SELECT vec_id, floor(least(255, probs[5] * 900))::INT AS r, floor(least(255, probs[3] * 900))::INT AS g, floor(least(255, probs[2] * 900))::INT AS b FROM scores""")
def rgb_stretch(spark, sf):
    rgb = P.stretch_to_rgb(F.col("probs"), [4, 2, 1], 900.0)
    return demo.class_scores(spark, sf).select("vec_id", *[F.get(rgb, F.lit(k)).alias(n) for k, n in enumerate("rgb")])


@register("ras072_centre_crop", f"WITH {demo.PX} SELECT scene_id, y - 5 AS y, x - 8 AS x, label FROM px WHERE y >= 5 AND y < 45 AND x >= 8 AND x < 42")
def centre_crop(spark, sf):
    return sampling.centre_crop(demo.orders_raster(spark, sf).select(*KEY, "label"), demo.SIDE, demo.SIDE, 34, 40)


@register("ras010_stack_bands", """
WITH f AS (SELECT l_orderkey AS px, l_suppkey AS scene_id, l_linenumber AS band, max(l_quantity)::BIGINT::VARCHAR AS q FROM lineitem GROUP BY ALL),
n AS (SELECT scene_id, count(DISTINCT n) > 1 AS unequal FROM (SELECT scene_id, band, count(*) // 10 AS n FROM f GROUP BY ALL) GROUP BY scene_id)
SELECT px, scene_id, string_agg(q, ',' ORDER BY band) AS bands, any_value(unequal) AS unequal FROM f JOIN n USING (scene_id) GROUP BY px, scene_id""")
def stack_bands(spark, sf):
    """With the size check: scenes whose bands hold unequal numbers of (tens of) pixels are marked."""
    from ..operators import align

    single = demo.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("px"), F.col("l_suppkey").alias("scene_id"), F.col("l_linenumber").alias("band")).agg(F.max("l_quantity").alias("value"))
    files = single.groupBy("scene_id", "band").agg(F.floor(F.count(F.lit(1)) / 10).alias("height"), F.lit(1).alias("width"))
    unequal = align.unequal_sizes(files, "scene_id", "height", "width").select("scene_id", F.lit(True).alias("_u"))
    out = align.stack_bands(single, ["px", "scene_id"]).join(unequal, "scene_id", "left")
    return out.select("px", "scene_id", F.array_join(F.transform("bands", lambda b: F.floor(b).cast("string")), ",").alias("bands"), F.coalesce("_u", F.lit(False)).alias("unequal"))


@register("ras011_append_band", f"WITH {demo.PX} SELECT scene_id, y, x, CASE WHEN v <= 100000 THEN -0.5 ELSE v END AS v, CASE WHEN w % 5 = 0 THEN 1.05::DOUBLE ELSE 0.05::DOUBLE * w END AS extra FROM px")
def append_band(spark, sf):
    from ..operators.align import append_band as append

    px = demo.orders_raster(spark, sf)
    extra = px.select(*KEY, F.when(W() % 5 == 0, F.lit(float("inf"))).otherwise(W()).alias("value"))
    out = append(px.withColumn("bands", F.transform("bands", lambda b: b - 100000)), extra, 0.05, floor_source=True)
    return out.select(*KEY, F.when(V() == -0.5, V()).otherwise(V() + 100000).alias("v"), F.get("bands", F.lit(2)).alias("extra"))


@register("ras130_read_window", f"WITH {demo.PX} SELECT scene_id, y, x, w AS first, v AS second FROM px WHERE x >= 10 AND x < 30 AND y >= 5 AND y < 25")
def read_window(spark, sf):
    px = grid.read_window(demo.orders_raster(spark, sf).select(*KEY, "bands"), (10, 5, 30, 25), (demo.SIDE, demo.SIDE), [1, 0])
    return px.select(*KEY, V().alias("first"), W().alias("second"))


@register("ras131_scene_metadata", f"""
WITH {demo.PX}, m AS (SELECT scene_id, substr(scene_id, 2)::INT AS k, max(y) + 1 AS height, max(x) + 1 AS width, count(*) AS pixels FROM px GROUP BY scene_id)
SELECT scene_id, height, width, 2 AS n_bands, pixels, 'double' AS dtype, 8 AS bytes_per_value, 0.5::DOUBLE AS pixel_x, 0.25::DOUBLE AS pixel_y, (k * 25)::DOUBLE AS min_x, 100 - height * 0.25::DOUBLE AS min_y,
       k * 25 + width * 0.5::DOUBLE AS max_x, 100.0::DOUBLE AS max_y, 'EPSG:32610' AS projection, 'scene ' || k AS title FROM m WHERE k % 4 <> 1""")
def scene_metadata(spark, sf):
    """Scenes whose header lacks the projection are rejected."""
    from ..operators import stats

    rows = stats.complete_scenes(stats.scene_metadata(demo.orders_raster(spark, sf), demo.order_headers(spark, sf)))
    b = F.col("bounds")
    return rows.select("scene_id", "height", "width", "n_bands", "pixels", "dtype", "bytes_per_value", "pixel_x", "pixel_y", *[b[s].alias(s) for s in ("min_x", "min_y", "max_x", "max_y")], "projection", F.col("tags")["title"].alias("title"))
