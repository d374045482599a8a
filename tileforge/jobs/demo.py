"""The given tables read as rasters, scenes, boxes and catalogs, in Spark and in SQL.

* ``orders`` is a dense raster: scenes of 50 x 50 pixels, bands (price, customer), labels by status.
* ``supplier`` gives scenes with a size, ``customer`` boxes.
* ``embeddings`` gives 8 x 8 tiles of one band, or scores for ten classes.
* ``lineitem`` gives observations of four bands by scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 50
#: Canonical index that stands for nodata among two classes.
NODATA = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, y, x, bands, label, priority): label 0, 1 or NODATA; priority 0..4."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("s"), F.floor(k / 2500).cast("string")).alias("scene_id"),
        F.floor((k % 2500) / SIDE).cast("int").alias("y"),
        (k % SIDE).cast("int").alias("x"),
        F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("bands"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(NODATA).alias("label"),
        (F.ascii("o_orderpriority") - 49).alias("priority"),
    )


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, gt, projection, tags) of the orders' scenes, side by side; every fourth has no projection."""
    k = F.substring("scene_id", 2, 18).cast("int")
    scenes = orders_raster(spark, sf_dir).select("scene_id").distinct()
    gt = F.array((k * 25).cast("double"), F.lit(0.5), F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(-0.25))
    return scenes.select("scene_id", gt.alias("gt"), F.when(k % 4 != 1, "EPSG:32610").alias("projection"), F.create_map(F.lit("title"), F.concat(F.lit("scene "), k.cast("string"))).alias("tags"))


def probability(bands: Column | str = "bands") -> Column:
    """A made-up score in [0, 1) from the first band."""
    return F.get(bands, F.lit(0)) / 500000


PX = """px AS (
    SELECT 's' || (o_orderkey // 2500) AS scene_id, ((o_orderkey % 2500) // 50)::INT AS y, (o_orderkey % 50)::INT AS x, o_totalprice AS v, o_custkey::DOUBLE AS w,
           CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, ascii(o_orderpriority) - 49 AS priority
    FROM orders
)"""


def supplier_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, width, height, gt): sizes from 20 to 79, an affine transform with pixels of 0.5 x -0.25."""
    s = table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(
        k.alias("scene_id"), (20 + k % 60).cast("int").alias("width"), (20 + (k * 7 + n) % 60).cast("int").alias("height"),
        F.array((k % 10 * 5).cast("double"), F.lit(0.5), F.lit(0.0), (100 + n).cast("double"), F.lit(0.0), F.lit(-0.25)).alias("gt"))


SCENES = """scenes AS (
    SELECT s_suppkey AS scene_id, (20 + s_suppkey % 60)::INT AS width, (20 + (s_suppkey * 7 + s_nationkey) % 60)::INT AS height,
           (s_suppkey % 10 * 5)::DOUBLE AS gx, (100 + s_nationkey)::DOUBLE AS gy FROM supplier
)"""


def customer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, box): integer boxes of 3..27 by 2..8; each thousand of them on its own stretch of about 1000 by 40 of the plane."""
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    x, y = (k * 37 % 1000 + F.floor(k / 1000) * 1000).cast("int"), (k % 41).cast("int")
    from ..functions.geometry import box

    return c.select(k.alias("id"), box(x, y, x + 3 + n, (y + 2 + k % 7).cast("int")).alias("box"))


BOXES = """boxes AS (
    SELECT c_custkey AS id, (c_custkey * 37 % 1000 + c_custkey // 1000 * 1000)::INT AS x0, (c_custkey % 41)::INT AS y0, (c_custkey * 37 % 1000 + c_custkey // 1000 * 1000)::INT + 3 + c_nationkey AS x1,
           ((c_custkey % 41)::INT + 2 + c_custkey % 7)::INT AS y1 FROM customer
)"""


def event_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scenes (scene_id, box, date) of 60 x 12 and label tiles (label_id, label_box, date) of 12 x 8, four columns to a user."""
    from ..functions.geometry import box

    e = table(spark, sf_dir, "events")
    k, x = F.col("event_id"), (F.col("user_id") * 4).cast("int")
    tile, date = F.col("event_type").isin("click", "view"), F.to_date("ts").alias("date")
    y, v = (k % 20).cast("int"), (k * 7 % 20).cast("int")
    scenes = e.filter(~tile).select(k.alias("scene_id"), box(x, y, x + 60, y + 12).alias("box"), date)
    return scenes, e.filter(tile).select(k.alias("label_id"), box(x, v, x + 12, v + 8).alias("label_box"), date)


def embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 tile of one band for each vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("scene_id"), F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col"), F.lit(0).alias("min_x"), F.lit(0).alias("min_y"),
        F.lit(8).alias("max_x"), F.lit(8).alias("max_y"), F.lit(1).alias("n_bands"), F.col("embedding").alias("data"), "label")


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, probs, label): the first ten values as class scores, made positive."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double"))).alias("probs"), "label")


SCORES = "scores AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: abs(x::DOUBLE)) AS probs, label FROM embeddings)"


def line_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, bands): four bands; a discount of 0 is nodata, NULL from here on."""
    line = table(spark, sf_dir, "lineitem")
    discount = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return line.select(F.col("l_suppkey").alias("scene_id"), F.array("l_quantity", "l_extendedprice", discount, F.col("l_tax") + 0.0).alias("bands"))
