"""Polygon regions: reading WKT, pixel coordinates, masks and evaluation by region.

Rings are ``array<struct<poly, hole, pts: array<struct<x, y>>>>``. A pixel belongs to a region when its centre (x + 0.5, y + 0.5)
lies inside by the even-odd rule, edge by edge; shapes are painted in order, so that a hole also clears what earlier shapes filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import confusion

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def parse_tags(tags: Column) -> Column:
    """Comma-separated, trimmed; empty means untagged."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def parse_wkt(wkt: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON; NULL for anything else. The first ring of a polygon is its outer one."""
    body = F.regexp_replace(F.upper(wkt), r"\s+", " ")
    body = F.regexp_replace(body, r"\) ?, ?\(", "),(")
    # a polygon starts where two or three brackets open; mark it, then number rings by the marks before them
    polygons = F.split(F.regexp_replace(F.regexp_replace(body, r"^ ?(MULTI)?POLYGON ?\(+ ?", ""), r" ?\)+ ?$", ""), r"\)\) ?, ?\(\(|\)\),\(\(")

    def ring(text: Column) -> Column:
        points = F.split(F.regexp_replace(text, r"[()]", ""), ",")
        return F.transform(points, lambda p: F.struct(F.split(F.trim(p), " ")[0].try_cast("double").alias("x"), F.split(F.trim(p), " ")[1].try_cast("double").alias("y")))

    rings = F.flatten(F.transform(polygons, lambda g, k: F.transform(F.split(g, r"\),\("), lambda t, i: F.struct(k.alias("poly"), (i > 0).alias("hole"), ring(t).alias("pts")))))
    return F.when(F.upper(F.trim(wkt)).rlike(r"^(MULTI)?POLYGON"), rings)


def to_pixels(rings: Column, transform: Column) -> Column:
    """Ring points from geo to (fractional) pixel coordinates."""
    return F.transform(rings, lambda r: F.struct(r["poly"].alias("poly"), r["hole"].alias("hole"), F.transform(r["pts"], lambda p: F.struct(((p["x"] - transform[0]) / transform[1]).alias("x"), ((p["y"] - transform[3]) / transform[5]).alias("y"))).alias("pts")))


def bounds(rings: Column) -> Column:
    """The whole-number box around the rings; NULL without points."""
    pts = F.flatten(F.transform(rings, lambda r: r["pts"]))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.when(F.size(pts) > 0, F.struct(F.floor(F.array_min(xs)).alias("min_x"), F.floor(F.array_min(ys)).alias("min_y"), F.ceil(F.array_max(xs)).alias("max_x"), F.ceil(F.array_max(ys)).alias("max_y")))


def row_spans(shapes: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """(keys, y, spans): of each pixel row the runs [x0, x1) that the shapes of a key cover, sorted and apart from each other.

    Shapes are painted in the order of their ids, and of a shape its rings in theirs: an outer ring fills, a hole clears what
    lies there by then, and a later shape may fill it again. By scan lines: every edge gives one crossing for each row of
    pixel centres that it crosses, so that work grows with the length of the outlines and not with their area, and no shape
    stays in one task. A ring's crossings of a row, sorted, are starts and ends of its runs in turn (even-odd); the last run
    that holds a pixel decides. ``shapes`` has scene_id, shape_id and rings besides the keys.
    """
    ring = shapes.select(*keys, "shape_id", F.posexplode("rings").alias("_ring", "_r")).withColumn("_n", F.size("_r.pts"))
    edge = ring.select(*keys, "shape_id", "_ring", F.col("_r.hole").alias("_hole"), F.posexplode("_r.pts").alias("_at", "a"), F.get("_r.pts", F.when(F.col("_at") + 1 < F.col("_n"), F.col("_at") + 1).otherwise(0)).alias("b"))
    low, high = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    first, last = F.greatest(F.lit(0), F.ceil(low - 0.5)), F.least(F.lit(height), F.ceil(high - 0.5)) - 1
    rows = edge.withColumns({"_first": first, "_last": last}).filter("_last >= _first").withColumn("y", F.explode(F.sequence("_first", "_last")))
    cross = (F.col("b.x") - F.col("a.x")) * (F.col("y") + 0.5 - F.col("a.y")) / (F.col("b.y") - F.col("a.y")) + F.col("a.x")
    lines = rows.groupBy(*keys, "shape_id", "_ring", "_hole", "y").agg(F.sort_array(F.collect_list(cross)).alias("_x"))
    at = lambda k: F.least(F.lit(width), F.greatest(F.lit(0), F.ceil(F.get("_x", k) - 0.5))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_x") / 2).cast("int") - 1), lambda i: F.struct(F.col("shape_id").alias("shape"), F.col("_ring").alias("ring"), at(2 * i).alias("x0"), at(2 * i + 1).alias("x1"), F.col("_hole").alias("hole")))
    runs = lines.select(*keys, F.col("y").cast("int").alias("y"), F.explode(runs).alias("_run")).filter("_run.x1 > _run.x0")
    found = runs.groupBy(*keys, "y").agg(F.sort_array(F.collect_list("_run")).alias("_runs"))

    def span(x0: Column, x1: Column) -> Column:
        return F.struct(x0.alias("x0"), x1.alias("x1"))

    def painted(done: Column, run: Column) -> Column:
        rest = F.flatten(F.transform(done, lambda s: F.filter(F.array(span(s["x0"], F.least(s["x1"], run["x0"])), span(F.greatest(s["x0"], run["x1"]), s["x1"])), lambda p: p["x1"] > p["x0"])))
        return F.when(run["hole"], rest).otherwise(F.concat(rest, F.array(span(run["x0"], run["x1"]))))

    spans = F.aggregate("_runs", F.array().cast("array<struct<x0:int,x1:int>>"), painted)
    return found.select(*keys, "y", F.array_sort(spans).alias("spans")).filter(F.size("spans") > 0)


#: Bytes of runs that are sent to every task; more are joined by a shuffle.
SENT_BYTES = 16 << 20


def sent(spans: DataFrame, shapes: DataFrame) -> DataFrame:
    """``spans`` of the ``shapes``, to be sent to every task where they are few: each edge gives a run for each pixel row at most."""
    def height(pts: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(pts)), F.lit(0.0), lambda n, k: n + F.abs(F.get(pts, k - 1)["y"] - F.get(pts, k % F.size(pts))["y"]) + 1)

    runs = shapes.agg(F.sum(F.aggregate("rings", F.lit(0.0), lambda n, r: n + F.when(F.size(r["pts"]) > 0, height(r["pts"])).otherwise(0.0)))).first()[0] or 0
    return F.broadcast(spans) if runs * 64 <= SENT_BYTES else spans


def span_pixels(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, x) of ``row_spans``, every pixel once for each key."""
    rows = spans.select(*keys, "y", F.explode("spans").alias("_s"))
    return rows.select(*keys, "y", F.explode(F.sequence(F.col("_s.x0"), F.col("_s.x1") - 1)).alias("x"))


def shape_pixels(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """(scene_id, shape_id, y, x): the pixels inside each shape."""
    named = shapes.select("scene_id", "shape_id", F.col("shape_id").alias("_id"), "rings")
    return span_pixels(row_spans(named.withColumnsRenamed({"shape_id": "_shape", "_id": "shape_id"}), width, height, "scene_id", "_shape"), "scene_id", "_shape").withColumnRenamed("_shape", "shape_id")


def mask_outside(pixels: DataFrame, shapes: DataFrame, value: str, nodata, width: int, height: int, keep_unshaped: bool = False) -> DataFrame:
    """``value`` is nodata outside the shapes of the scene; a scene without shapes is masked wholly, or left as it is with ``keep_unshaped``."""
    covered = sent(row_spans(shapes, width, height, "scene_id"), shapes)
    rows = pixels.join(covered, ["scene_id", "y"], "left")
    held = F.coalesce(F.exists("spans", lambda s: (F.col("x") >= s["x0"]) & (F.col("x") < s["x1"])), F.lit(False))
    if keep_unshaped:
        shaped = shapes.select("scene_id").distinct().withColumn("_shaped", F.lit(True))
        rows = rows.join(F.broadcast(shaped) if shaped.count() * 64 <= SENT_BYTES else shaped, "scene_id", "left")
        held = held | F.col("_shaped").isNull()
    return rows.withColumn(value, F.when(held, F.col(value)).otherwise(F.lit(nodata))).drop("spans", "_shaped")


def by_region(pixels: DataFrame, shapes: DataFrame, tags: list[str], width: int, height: int) -> DataFrame:
    """``pixels`` once for region ``all`` and once for each region that holds it.

    A wanted tag pools its shapes, painted in order (a pixel counts once); every untagged shape is a region of its own, ``shape <id>``.
    """
    own = F.when(F.size("tags") == 0, F.array(F.concat(F.lit("shape "), F.col("shape_id").cast("string")))).otherwise(F.filter("tags", lambda t: t.isin(tags)))
    named = shapes.select("scene_id", "shape_id", "rings", F.explode(own).alias("region"))
    rows = row_spans(named, width, height, "scene_id", "region").groupBy("scene_id", "y").agg(F.collect_list(F.struct("region", "spans")).alias("_regions"))
    held = F.filter("_regions", lambda r: F.exists(r["spans"], lambda s: (F.col("x") >= s["x0"]) & (F.col("x") < s["x1"])))
    every = F.concat(F.array(F.lit("all")), F.coalesce(F.transform(held, lambda r: r["region"]), F.array().cast("array<string>")))
    return pixels.join(sent(rows, named), ["scene_id", "y"], "left").withColumn("region", F.explode(every)).drop("_regions")


def region_confusion(pixels: DataFrame, shapes: DataFrame, tags: list[str], width: int, height: int, true: str, pred: str, classes: int, nodata: int) -> DataFrame:
    """(region, scene_id, true_class, pred_class, n): for each region in each scene and, with a NULL scene, in all of them.

    Pixels are counted once, by region and scene; the sums over scenes come from these counts.
    """
    rows = by_region(pixels, shapes, tags, width, height)
    conf = confusion(rows, true, pred, classes, nodata, ("region", "scene_id"))
    return conf.rollup("region", "true_class", "pred_class", "scene_id").agg(F.sum("n").alias("n")).filter("pred_class IS NOT NULL")
