"""Catalogs: pairing images with labels, header and name parsing, filters, splits and reports of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import intersection, pixel_to_geo
from ..functions.pixels import uniform
from .grid import box_overlap_join

#: Header tags that come with a band number.
BAND_TAGS = ("RADIANCE_MULT", "RADIANCE_ADD", "REFLECTANCE_MULT", "REFLECTANCE_ADD", "K1_CONSTANT", "K2_CONSTANT", "FILE_NAME")
#: Zero-based places of the thermal bands that carry two gains.
VCID = {"6_VCID_1": 6, "6_VCID_2": 9}
#: Bands to use, by the digit in the sensor's name.
SENSOR_BANDS = {"5": [1, 2, 3, 4, 5, 6, 7], "7": [1, 2, 3, 4, 5, 6, 7], "8": [1, 2, 3, 4, 5, 6, 7, 9]}


def pair_labels(images: DataFrame, labels: DataFrame, image_ext: str, label_ext: str) -> DataFrame:
    """(path, label_path): the label has the image's relative path with the other extension; unmatched on either side are NULL."""
    stem = F.regexp_replace("path", F.lit(_ext(image_ext)), F.lit(""))
    other = labels.select(F.col("path").alias("label_path"), F.regexp_replace("path", F.lit(_ext(label_ext)), F.lit("")).alias("_stem"))
    return images.withColumn("_stem", stem).join(other, "_stem", "full").drop("_stem")


def _ext(extension: str) -> str:
    return extension.replace(".", r"\.") + "$"


def drop_labels_among_images(paths: DataFrame, label_ext: str) -> DataFrame:
    return paths.filter(~F.col("path").endswith(label_ext))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected rows that were not found."""
    return expected.join(found.select(key).distinct(), key, "left_anti")


def not_done(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without a valid output."""
    return missing(inputs, outputs.filter("valid"), key)


def size_mismatches(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~(F.col("image_h").eqNullSafe(F.col("label_h")) & F.col("image_w").eqNullSafe(F.col("label_w"))))


def part_count(names: DataFrame, *keys: str) -> DataFrame:
    """The largest number of names of the form ``<int>_<rest>`` with one underscore; 0 if there is none."""
    p = F.split("name", "_")
    n = F.when(F.size(p) == 2, p[0].try_cast("int"))
    return names.groupBy(*keys).agg(F.coalesce(F.max(n), F.lit(0)).alias("parts"))


def header_lines(headers: DataFrame) -> DataFrame:
    """(scene_id, line, tag, value) of texts with ``TAG = value`` lines; quotes and semicolons are dropped, tags in upper case."""
    rows = headers.select("scene_id", F.posexplode(F.split("text", "\n")).alias("line", "_l"))
    parts = F.split(F.regexp_replace("_l", '[";]', ""), "=", 2)
    return rows.filter(F.col("_l").contains("=")).select("scene_id", "line", F.upper(F.trim(parts[0])).alias("tag"), F.trim(parts[1]).alias("value"))


def mtl_coefficients(lines: DataFrame) -> DataFrame:
    """One row per scene and zero-based band with a column for each of BAND_TAGS: numbers, but for the file's name."""
    tag = F.regexp_extract("tag", "^(" + "|".join(BAND_TAGS) + ")_BAND_(.+)$", 1)
    suffix = F.regexp_extract("tag", "^(" + "|".join(BAND_TAGS) + ")_BAND_(.+)$", 2)
    band = suffix.try_cast("int") - 1
    for name, place in VCID.items():
        band = F.when(suffix == name, place).otherwise(band)
    rows = lines.select("scene_id", tag.alias("tag"), band.alias("band"), "value").filter("tag <> '' AND band IS NOT NULL")
    wide = rows.groupBy("scene_id", "band").pivot("tag", list(BAND_TAGS)).agg(F.min("value"))
    return wide.withColumns({t: F.col(t).try_cast("double") for t in BAND_TAGS if t != "FILE_NAME"})


def scalar_tag(lines: DataFrame, tag: str, out: str) -> DataFrame:
    return lines.filter(F.col("tag") == tag).groupBy("scene_id").agg(F.min("value").try_cast("double").alias(out))


def imd_coefficients(lines: DataFrame) -> DataFrame:
    """(scene_id, band, abscal, bandwidth): the tags come once for each band, in the order of the file."""
    rows = lines.filter(F.col("tag").isin("ABSCALFACTOR", "EFFECTIVEBANDWIDTH"))
    rows = rows.withColumn("band", F.row_number().over(Window.partitionBy("scene_id", "tag").orderBy("line")) - 1)
    return rows.groupBy("scene_id", "band").pivot("tag", ["ABSCALFACTOR", "EFFECTIVEBANDWIDTH"]).agg(F.first(F.col("value").try_cast("double"))).withColumnsRenamed({"ABSCALFACTOR": "abscal", "EFFECTIVEBANDWIDTH": "bandwidth"})


def landsat_name(name: Column) -> Column:
    p = F.split(name, "_")
    return F.struct(p[0].alias("sensor"), F.substring(F.get(p, F.lit(2)), 1, 3).alias("path"), F.substring(F.get(p, F.lit(2)), 4, 3).alias("row"), F.to_date(F.try_to_timestamp(F.get(p, F.lit(3)), F.lit("yyyyMMdd"))).alias("acquired"))


def worldview_name(name: Column) -> Column:
    p = F.split(name, "_")
    day = F.substring(F.get(p, F.lit(2)), 7, 8)
    return F.struct(F.substring(p[0], 1, 4).alias("sensor"), F.to_date(F.try_to_timestamp(day, F.lit("yyyyMMdd"))).alias("acquired"))


def sensor_bands(sensor: Column) -> Column:
    """The bands to use by the digit that the sensor's name contains; empty for others."""
    out = F.array().cast("array<int>")
    for digit, chosen in reversed(SENSOR_BANDS.items()):
        out = F.when(sensor.contains(digit), F.array(*map(F.lit, chosen))).otherwise(out)
    return out


def elevation_tile_bounds(name: Column) -> Column:
    """``N18W077`` to its box of one degree."""
    lat = F.substring(name, 2, 2).cast("int") * F.when(F.substring(name, 1, 1) == "S", -1).otherwise(1)
    lon = F.substring(name, 5, 3).cast("int") * F.when(F.substring(name, 4, 1) == "W", -1).otherwise(1)
    return F.struct(lon.alias("min_x"), lat.alias("min_y"), (lon + 1).alias("max_x"), (lat + 1).alias("max_y"))


def wanted_events(events: DataFrame, name: str, targets: list[str], skips: list[str], downloadable: str | None = None) -> DataFrame:
    """Names that hold any target and no skip word, in any case; of these those that the column ``downloadable`` allows."""
    low = F.lower(F.col(name))
    words = lambda ws: F.array(*map(F.lit, ws))
    rows = events.filter(F.exists(words(targets), lambda w: low.contains(w)) & ~F.exists(words(skips), lambda w: low.contains(w)))
    return rows if downloadable is None else rows.filter(F.col(downloadable))


def wanted_scenes(catalog: DataFrame, pairs: list[tuple[str, str]], existing: DataFrame, least_bands: int = 8, names: DataFrame | None = None) -> DataFrame:
    """Catalog rows with a wanted (platform, sensor) in any case, enough bands (or no such field), not yet there.

    Rows without scene_id, entity_id or summary are out, and with ``names`` (scene_id) all others than these. ``summary``
    holds ``key:value`` parts between commas, ``fields`` is an array of (name, value).
    """
    of = lambda key: F.trim(F.regexp_extract(F.lower("summary"), rf"{key}:\s*([^,:]*)", 1))
    rows = catalog
    for required in ("scene_id", "entity_id", "summary"):
        rows = rows.filter(F.coalesce(F.col(required), F.lit("")) != "")
    rows = rows if names is None else rows.join(names.select("scene_id").distinct(), "scene_id", "left_semi")
    rows = rows.withColumns({"platform": of("platform"), "sensor": of("sensor")})
    rows = rows.filter(F.concat_ws("/", "platform", "sensor").isin([f"{p}/{s}".lower() for p, s in pairs]))
    bands = F.filter("fields", lambda x: x["name"] == "bands")
    rows = rows.filter((F.size(bands) <= 0) | (F.get(bands, F.lit(0))["value"].try_cast("int") >= least_bands))
    return rows.join(existing.select("scene_id").distinct(), "scene_id", "left_anti")


def stem_of(path: Column) -> Column:
    """The file's name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def random_split(paths: DataFrame, path: str, fraction: float, seed: int, include: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """``split``: each path falls to validation with the fraction, by its own hash.

    With ``include`` (stem) only images of these names take part, with ``most`` so many of them, the first by a hash. A label
    column of ``paths`` (see ``pair_labels``) goes where its image goes.
    """
    rows = paths if include is None else paths.join(include.select(F.col("stem").alias("_stem")).distinct(), stem_of(F.col(path)) == F.col("_stem"), "left_semi")
    if most is not None:
        rows = rows.orderBy(F.md5(F.concat_ws(":", F.lit(f"{seed}:first"), F.col(path))), path).limit(most)
    return rows.withColumn("split", F.when(uniform(seed, F.col(path)) < fraction, "validation").otherwise("train"))


def mirrored_path(path: Column, base: str, out: str, prefix: str = "", extension: str = ".tiff") -> Column:
    """The output path: relative to ``base``, same folders, new prefix and extension; files at the root get a folder of their stem."""
    rel = F.regexp_replace(path, F.lit("^" + base.rstrip("/") + "/"), F.lit(""))
    folder = F.regexp_extract(rel, "^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(rel, "([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat_ws("/", F.lit(out), F.when(folder == "", stem).otherwise(folder), F.concat(F.lit(prefix), stem, F.lit(extension)))


def first_per_scene(matches: DataFrame, scene: str, order: list[str], most: int = 12) -> DataFrame:
    """At most ``most`` matches for each scene, first by ``order``."""
    return matches.withColumn("_n", F.row_number().over(Window.partitionBy(scene).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def scene_labels(scenes: DataFrame, labels: DataFrame, pixels: DataFrame, cell: int) -> DataFrame:
    """(scene_id, y, x, label): all label tiles of a scene's date and place, put together on the scene's own grid.

    ``scenes`` has scene_id, gt, width, height, box and date; ``labels`` label_id, label_gt, label_box and date; ``pixels``
    label_id, y, x, label. Of overlapping tiles the one with the higher id wins; scene pixels that no tile covers are NULL.
    A scene pixel takes the label under its centre (nearest). Pixels of a label tile meet only scenes that its box overlaps.
    All joins are shuffled: how many rows pixels have been made of is in no estimate of their size, by which they might be sent.
    """
    met = labels_on_date(scenes.select("scene_id", "box", "date"), labels.select("label_id", "label_box", "date"), cell, None)
    met = met.join(scenes.select("scene_id", "gt", "width", "height", F.col("box").alias("_box")).hint("merge"), "scene_id").join(labels.select("label_id", "label_gt", "label_box").hint("merge"), "label_id")
    # the part of the scene's grid whose centres lie in the tile
    both = intersection(F.col("_box"), F.col("label_box"))

    def index(geo: Column, origin: int, step: int) -> Column:
        return (geo - F.col("gt")[origin]) / F.col("gt")[step]

    xs, ys = [index(both["min_x"], 0, 1), index(both["max_x"], 0, 1)], [index(both["min_y"], 3, 5), index(both["max_y"], 3, 5)]
    first = lambda v, size: F.greatest(F.lit(0), F.ceil(F.least(*v) - 0.5))
    last = lambda v, size: F.least(F.col(size), F.ceil(F.greatest(*v) - 0.5)) - 1
    rows = met.withColumns({"_x0": first(xs, "width"), "_x1": last(xs, "width"), "_y0": first(ys, "height"), "_y1": last(ys, "height")}).filter("_x1 >= _x0 AND _y1 >= _y0")
    rows = rows.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    here = pixel_to_geo(F.col("gt"), F.col("x") + 0.5, F.col("y") + 0.5)
    t = F.col("label_gt")
    rows = rows.select("scene_id", "label_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.floor((here["gx"] - t[0]) / t[1]).cast("int").alias("_sx"), F.floor((here["gy"] - t[3]) / t[5]).cast("int").alias("_sy"))
    source = pixels.select("label_id", F.col("y").alias("_sy"), F.col("x").alias("_sx"), "label").filter("label IS NOT NULL")
    found = rows.join(source.hint("merge"), ["label_id", "_sy", "_sx"]).groupBy("scene_id", "y", "x").agg(F.max_by("label", "label_id").alias("label"))
    grid = scenes.select("scene_id", "width", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("y"))
    grid = grid.select("scene_id", "y", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("x"))
    return grid.join(found.hint("merge"), ["scene_id", "y", "x"], "left")


def labels_on_date(scenes: DataFrame, labels: DataFrame, cell: int, most: int | None = 12) -> DataFrame:
    """(scene_id, label_id): label tiles whose box overlaps the scene's on its date, at most ``most`` for each scene, if given.

    ``scenes`` has scene_id, box and date, ``labels`` label_id, label_box and date; the lowest label ids come first.
    """
    met = box_overlap_join(scenes, labels, "box", "label_box", cell, on=("date",))
    return (met if most is None else first_per_scene(met, "scene_id", ["label_id"], most)).select("scene_id", "label_id")
