"""Combining rasters: band stacks, mosaics, resampling, differences and simple terrain measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, footprint, geo_to_pixel, intersection
from ..functions.pixels import toa_landsat

PIXEL = ["scene_id", "y", "x"]


def stack_bands(single: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, band, value) to one row per key with ``bands`` in the order of ``band``.

    A key with fewer bands than others shows bands of unequal size: its row is there, with what there is; ``unequal_sizes``
    names the images that must not be stacked.
    """
    rows = single.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("band", "value"))).alias("_b"))
    return rows.withColumn("bands", F.transform("_b", lambda b: b["value"])).drop("_b")


def unequal_sizes(images: DataFrame, group: str, height: str, width: str) -> DataFrame:
    """Groups whose members differ in size."""
    sizes = images.groupBy(group).agg(F.count_distinct(F.struct(height, width)).alias("sizes"))
    return sizes.filter("sizes > 1")


def append_band(pixels: DataFrame, extra: DataFrame, factor: float, floor_source: bool = False) -> DataFrame:
    """``pixels`` with the raster ``extra`` (key, value) as one more band: infinite becomes 1.05, else times the factor.

    With ``floor_source`` source bands that are not positive become -0.5. Every source pixel is kept; where ``extra`` has none the
    new band is NULL.
    """
    value = F.when(F.abs(F.col("_extra")) == float("inf"), 1.05).otherwise(F.col("_extra") * factor)
    rows = pixels.join(extra.withColumnRenamed("value", "_extra"), PIXEL, "left")
    own = F.transform("bands", lambda b: F.when(b <= 0, -0.5).otherwise(b)) if floor_source else F.col("bands")
    return rows.withColumn("bands", F.concat(own, F.array(value))).drop("_extra")


def images_equivalent(pairs: DataFrame, checks: list[str], left: str = "a", right: str = "b") -> DataFrame:
    """``same``: whether the two struct columns agree in all fields of ``checks``."""
    same = F.lit(True)
    for c in checks:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return pairs.withColumn("same", same)


#: What two images are compared by; each can be switched off.
CHECKS = ("projection", "dtype", "n_bands", "size", "resolution", "coverage")


def comparable(scenes: DataFrame) -> DataFrame:
    """``scenes`` (gt, width, height, projection, dtype, n_bands) with the struct ``facts`` of CHECKS."""
    g = F.col("gt")
    size, resolution = F.struct("width", "height"), F.struct(g[1].alias("x"), g[5].alias("y"))
    return scenes.withColumn("facts", F.struct("projection", "dtype", "n_bands", size.alias("size"), resolution.alias("resolution"), footprint(g, F.col("width"), F.col("height")).alias("coverage")))


def overlap_windows(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``area``, the geo box that two scenes share, and ``a_window`` and ``b_window``, the same in pixels of each.

    ``a`` and ``b`` are structs with gt, width and height. Boxes that only touch share a box without area; disjoint pairs
    have NULLs. Rasters are north-up.
    """
    one, two = F.col(a), F.col(b)
    area = intersection(footprint(one["gt"], one["width"], one["height"]), footprint(two["gt"], two["width"], two["height"]))
    rows = pairs.withColumn("area", F.when((area["max_x"] >= area["min_x"]) & (area["max_y"] >= area["min_y"]), area))

    def window(s: Column) -> Column:
        low, high = geo_to_pixel(s["gt"], F.col("area.min_x"), F.col("area.max_y")), geo_to_pixel(s["gt"], F.col("area.max_x"), F.col("area.min_y"))
        return F.when(F.col("area").isNotNull(), box(low["x"], low["y"], high["x"], high["y"]))

    return rows.withColumns({"a_window": window(one), "b_window": window(two)})


def common_area(boxes: DataFrame, box: str, *keys: str) -> DataFrame:
    """The box that all boxes of a group share; groups without one are left out."""
    b = F.col(box)
    rows = boxes.groupBy(*keys).agg(F.max(b["min_x"]).alias("min_x"), F.max(b["min_y"]).alias("min_y"), F.min(b["max_x"]).alias("max_x"), F.min(b["max_y"]).alias("max_y"))
    return rows.filter("min_x < max_x AND min_y < max_y")


def mosaic(pixels: DataFrame, order: str, key: list[str] = ["gy", "gx"]) -> DataFrame:  # noqa: B006
    """One value per global pixel: of overlapping inputs the later one wins. An aggregate, no sort."""
    return pixels.groupBy(*key).agg(F.max_by("bands", order).alias("bands"))


def mosaic_plan(scenes: DataFrame, group: str, order: str) -> DataFrame:
    """``scenes`` with ``offset_x``, ``offset_y`` in their group's mosaic, its ``total_width`` and ``total_height``, and ``fits``.

    A group's first scene is what the others are compared with, in all of CHECKS but size and coverage; a group with a scene
    that differs has ``fits`` false throughout. A small table: one row for each scene.
    """
    checks = [c for c in CHECKS if c not in ("size", "coverage")]
    rows = comparable(scenes)
    b = F.col("facts.coverage")
    first = rows.groupBy(group).agg(F.min_by("facts", order).alias("_ref"), F.min(b["min_x"]).alias("_x0"), F.max(b["max_y"]).alias("_y0"), F.max(b["max_x"]).alias("_x1"), F.min(b["min_y"]).alias("_y1"))
    rows = images_equivalent(rows.join(first, group), checks, "facts", "_ref")
    step_x, step_y = F.abs(F.col("_ref.resolution.x")), F.abs(F.col("_ref.resolution.y"))
    whole = lambda v: F.round(v).cast("int")
    rows = rows.withColumns({"offset_x": whole((b["min_x"] - F.col("_x0")) / step_x), "offset_y": whole((F.col("_y0") - b["max_y"]) / step_y), "total_width": whole((F.col("_x1") - F.col("_x0")) / step_x), "total_height": whole((F.col("_y0") - F.col("_y1")) / step_y)})
    differ = rows.groupBy(group).agg(F.min("same").alias("fits"))
    return rows.join(differ, group).drop("facts", "_ref", "_x0", "_y0", "_x1", "_y1", "same")


def mosaic_scenes(scenes: DataFrame, pixels: DataFrame, group: str, order: str, nodata: float) -> DataFrame:
    """(group, y, x, bands) of every group whose scenes fit together: placed by geotransform, gaps filled with nodata.

    Where scenes overlap the one that is later in ``order`` wins. ``mosaic_plan`` tells the groups that do not fit.
    """
    plan = mosaic_plan(scenes, group, order).filter("fits")
    placed = pixels.join(plan.select("scene_id", group, order, "offset_x", "offset_y"), "scene_id")
    found = mosaic(placed.select(group, order, (F.col("y") + F.col("offset_y")).alias("y"), (F.col("x") + F.col("offset_x")).alias("x"), "bands"), order, [group, "y", "x"])
    sizes = plan.groupBy(group).agg(F.max("total_width").alias("_w"), F.max("total_height").alias("_h"), F.max("n_bands").alias("_n"))
    cells = sizes.select(group, "_w", "_n", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("y")).select(group, "_n", "y", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("x"))
    gap = F.array_repeat(F.lit(float(nodata)), F.col("_n").cast("int"))
    return cells.join(found, [group, "y", "x"], "left").select(group, "y", "x", F.coalesce("bands", gap).alias("bands"))


def calibrated(pixels: DataFrame, coefficients: DataFrame, sun: DataFrame) -> DataFrame:
    """``pixels`` with ``bands`` calibrated by their scene's header: temperature for bands that have K1, reflectance for others.

    ``coefficients`` is the table of ``mtl_coefficients``, ``sun`` (scene_id, sun). Both are one row for each scene, or band of
    one; pixels without a header are left out. Scenes with a missing coefficient get NULL bands there.
    """
    tags = {"rmult": "REFLECTANCE_MULT", "radd": "REFLECTANCE_ADD", "mult": "RADIANCE_MULT", "add": "RADIANCE_ADD", "k1": "K1_CONSTANT", "k2": "K2_CONSTANT"}
    rows = coefficients.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("band", *tags.values()))).alias("_c"))

    def values(tag: str) -> Column:
        return F.transform("_c", lambda c: c[tag])

    arrays = [values(t).alias(n) for n, t in tags.items()]
    facts = rows.join(sun, "scene_id").select("scene_id", F.struct(*arrays, F.col("sun").alias("sun_elevation")).alias("_c"))
    return pixels.join(facts, "scene_id").withColumn("bands", toa_landsat(F.col("bands"), F.col("_c"))).drop("_c")


def resample_nearest(target: DataFrame, source: DataFrame, to_source_y: Column, to_source_x: Column) -> DataFrame:
    """For each pixel of ``target`` the source pixel under its centre; NULL outside the source."""
    rows = target.withColumns({"_sy": F.floor(to_source_y).cast("int"), "_sx": F.floor(to_source_x).cast("int")})
    src = source.select(F.col("scene_id"), F.col("y").alias("_sy"), F.col("x").alias("_sx"), "bands")
    return rows.join(src, ["scene_id", "_sy", "_sx"], "left").drop("_sy", "_sx")


def resample_bilinear(target: DataFrame, source: DataFrame, to_source_y: Column, to_source_x: Column) -> DataFrame:
    """Weighted mean of the four nearest source pixel centres per band; missing and NULL neighbours drop out of the weights.

    Coordinates are in source pixels with centres at .5. Four rows per target pixel meet the source in an equi-join that is shuffled:
    how many rows target pixels have been made of is in no estimate of their size, by which they might be sent to every task.
    """
    rows = target.withColumns({"_fy": to_source_y - 0.5, "_fx": to_source_x - 0.5})
    near = F.array(*[F.struct((F.floor("_fy") + dy).cast("int").alias("sy"), (F.floor("_fx") + dx).cast("int").alias("sx"),
                              ((F.lit(1 - dy) + (2 * dy - 1) * (F.col("_fy") - F.floor("_fy"))) * (F.lit(1 - dx) + (2 * dx - 1) * (F.col("_fx") - F.floor("_fx")))).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    rows = rows.withColumn("_n", F.explode(near)).filter("_n.w > 0").select(*PIXEL, F.col("_n.sy").alias("_sy"), F.col("_n.sx").alias("_sx"), F.col("_n.w").alias("_w"))
    src = source.select("scene_id", F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.posexplode("bands").alias("band", "_v")).filter("_v IS NOT NULL")
    met = rows.join(src.hint("merge"), ["scene_id", "_sy", "_sx"])
    return met.groupBy(*PIXEL, "band").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("value"))


def onto_grid(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Crop or pad to the box of each scene (min_y .. max_x); outside the raster bands are NULL."""
    grid = boxes.filter("max_y > min_y AND max_x > min_x").select("scene_id", F.explode(F.sequence(F.col("min_y"), F.col("max_y") - 1)).alias("y"), "min_x", "max_x")
    grid = grid.select("scene_id", "y", F.explode(F.sequence(F.col("min_x"), F.col("max_x") - 1)).alias("x"))
    return grid.join(pixels, PIXEL, "left")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """A byte per pixel: mean square difference over the bands times 128, cut to 0..255."""
    rows = a.select(*PIXEL, F.col("bands").alias("_a")).join(b.select(*PIXEL, F.col("bands").alias("_b")), PIXEL)
    total = F.aggregate(F.zip_with("_a", "_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return rows.select(*PIXEL, F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), total / F.size("_a") * 128))).cast("int").alias("diff"))


def height_above_ground(surface: DataFrame, ground: DataFrame) -> DataFrame:
    """Surface height less ground height per pixel."""
    return surface.join(ground.withColumnRenamed("value", "_g"), PIXEL).withColumn("value", F.col("value") - F.col("_g")).drop("_g")


def roughness(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Largest less smallest value of the 3 x 3 window; NULL unless all nine cells have a value.

    Two window passes, over x then y; frames are by coordinate, so missing pixels are no neighbours.
    """
    along = Window.partitionBy("scene_id", "y").orderBy("x").rangeBetween(-1, 1)
    across = Window.partitionBy("scene_id", "x").orderBy("y").rangeBetween(-1, 1)
    rows = pixels.select(*PIXEL, F.min(value).over(along).alias("_lo"), F.max(value).over(along).alias("_hi"), F.count(value).over(along).alias("_n"))
    rows = rows.select(*PIXEL, F.min("_lo").over(across).alias("_lo"), F.max("_hi").over(across).alias("_hi"), F.sum("_n").over(across).alias("_n"))
    return rows.select(*PIXEL, F.when(F.col("_n") == 9, F.col("_hi") - F.col("_lo")).alias("roughness"))
