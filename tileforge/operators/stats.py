"""Statistics of rasters and labels: band figures, histograms, class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import footprint


#: Bytes of a value, by the Spark type of the array of bands.
BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
REQUIRED = ("height", "width", "n_bands", "dtype", "pixel_x", "pixel_y", "bounds", "projection")


def scene_metadata(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """One row for each scene: size, bands, type and bytes of a value, pixel size, bounds, projection, tags and pixel count.

    ``headers`` has scene_id, gt, projection and tags (map). Scenes without a header, or with an item of REQUIRED missing, are
    there too; ``complete`` tells them apart.
    """
    kind = pixels.schema["bands"].dataType.elementType.simpleString()
    rows = pixels.groupBy("scene_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.max(F.size("bands")).alias("n_bands"), F.count(F.lit(1)).alias("pixels"))
    rows = rows.withColumns({"dtype": F.lit(kind), "bytes_per_value": F.lit(BYTES.get(kind))}).join(headers.select("scene_id", "gt", "projection", "tags"), "scene_id", "left")
    g = F.col("gt")
    rows = rows.withColumns({"pixel_x": F.abs(F.get(g, F.lit(1))), "pixel_y": F.abs(F.get(g, F.lit(5))), "bounds": F.when(F.size(g) == 6, footprint(g, F.col("width"), F.col("height")))}).drop("gt")
    complete = F.col("n_bands") > 0
    for c in REQUIRED:
        complete = complete & F.col(c).isNotNull()
    return rows.withColumn("complete", complete)


def complete_scenes(metadata: DataFrame) -> DataFrame:
    return metadata.filter("complete").drop("complete")


def band_statistics(pixels: DataFrame) -> DataFrame:
    """min, max, mean and population deviation by scene and band; NULL values are left out."""
    rows = pixels.select("scene_id", F.posexplode("bands").alias("band", "value")).filter("value IS NOT NULL")
    return rows.groupBy("scene_id", "band").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def average_statistics(per_scene: DataFrame) -> DataFrame:
    """The mean over scenes of each scene's figures."""
    return per_scene.groupBy("band").agg(*[F.avg(c).alias(c) for c in ("lowest", "highest", "mean", "deviation")])


def class_shares(labels: DataFrame, nodata: int, key: str = "scene_id") -> DataFrame:
    """Pixel counts by scene and class with totals (scene NULL): share over valid pixels, for nodata over all."""
    counts = labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.unionByName(counts.groupBy("label").agg(F.sum("n").alias("n")).withColumn(key, F.lit(None).cast(counts.schema[key].dataType)))
    scene = Window.partitionBy(key)
    every, valid = F.sum("n").over(scene), F.sum(F.when(F.col("label") != nodata, F.col("n")).otherwise(0)).over(scene)
    return rows.withColumn("share", F.try_divide(F.col("n"), F.when(F.col("label") == nodata, every).otherwise(valid)))


def band_histogram(pixels: DataFrame, band: int, bins: int = 200, cap: float | None = 2.0) -> DataFrame:
    """Counts by scene and bin over the range of the data: positive values, cut at ``cap``."""
    value = F.get("bands", F.lit(band))
    rows = pixels.select("scene_id", (value if cap is None else F.least(value, F.lit(cap))).alias("v")).filter("v > 0")
    ranges = rows.groupBy("scene_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = rows.join(ranges, "scene_id")
    place = F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(0))
    return rows.groupBy("scene_id", F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
