"""Queries over catalogs, headers, samples, streams and registries."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import batch, catalog, evaluate, grid, registry, sampling
from ..sources import files
from ..streaming import scenes as streams
from . import demo, evaluation_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = ["scene_id", "y", "x"]
#: Heights that the remainder of an elevation grid tells apart, and a remainder beyond these, of pixels that are not there.
HGT_SPAN, HGT_ABSENT = 1 << 15, (1 << 15) - 1


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _u(seed: int, *parts: str) -> str:
    """SQL of ``functions.pixels.uniform``."""
    return "(('0x' || substr(md5('" + str(seed) + ":' || " + " || ':' || ".join(parts) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _image_paths(spark, sf):
    return demo.table(spark, sf, "documents").select(F.concat(F.lit("data/"), "lang", F.lit("/img"), F.col("doc_id").cast("string"), F.lit(".tiff")).alias("path"))


def _label_paths(spark, sf):
    d = demo.table(spark, sf, "documents").join(demo.table(spark, sf, "labels"), "doc_id")
    return d.select(F.concat(F.lit("data/"), "lang", F.lit("/img"), F.col("doc_id").cast("string"), F.lit("_label.tiff")).alias("path"))


PATHS = "SELECT doc_id, 'data/' || lang || '/img' || doc_id AS stem FROM documents"


@register("ras001_paths_by_extension", "SELECT lang || '/' || doc_id || '.tiff' AS path, octet_length(encode(coalesce(text, ''))) AS length FROM documents WHERE doc_id % 3 = 0 AND lang IS NOT NULL")
def paths_by_extension(spark, sf):
    """Files in nested folders, a third of them with the extension that is looked for; found by name, not read."""
    d = demo.table(spark, sf, "documents").filter("lang IS NOT NULL")
    extension = F.when(F.col("doc_id") % 3 == 0, ".tiff").otherwise(".txt")
    name = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), extension)
    root = _scratch(spark)
    _act(files.write_files(d.select(name.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), root))
    found = files.image_paths(spark, directory=root)
    return found.select(F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("path"), "length")


def _act(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _member(content):
    """One zip archive for each row's member ``m.txt``; every tenth archive is broken."""


    out = []
    for c in content:
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(zipfile.ZipInfo("m.txt"), c)
        out.append(b.getvalue() if int(c.split(",")[0]) % 10 else b"broken")
    return pd.Series(out)


@register("ras004_numpy_images", "SELECT vec_id::VARCHAR AS scene_id, (i // 8)::INT AS y, (i % 8)::INT AS x, embedding[i + 1]::DOUBLE AS value FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)")
def numpy_images(spark, sf):
    """Arrays of two dimensions, written as files and read as tiles of one band."""

    @F.pandas_udf("binary")
    def saved(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            b = io.BytesIO()
            np.save(b, np.asarray(r, np.float32).reshape(8, 8))
            out.append(b.getvalue())
        return pd.Series(out)

    root = _scratch(spark)
    e = files.spread(demo.table(spark, sf, "embeddings"))
    _act(files.write_files(e.select(F.concat(F.col("vec_id").cast("string"), F.lit(".npy")).alias("path"), saved("embedding").alias("content")), root))
    px = grid.tiles_to_pixels(files.read_npy(spark, root, rows_per_tile=3).filter("error IS NULL"))
    return px.select(*KEY, F.get("bands", F.lit(0)).cast("double").alias("value"))


@register("ras005_elevation_grids", f"""
WITH {demo.PX}, h AS (SELECT scene_id, substr(scene_id, 2)::INT AS k, y, x, CASE WHEN label = 2 THEN NULL ELSE (w - 500)::INT END AS height FROM px WHERE substr(scene_id, 2)::INT % 2 = 0)
SELECT k % 90 AS min_y, -(k % 180) AS min_x, y, x, height::DOUBLE AS height, 1 / 49.0::DOUBLE AS pixel_size FROM h""")
def elevation_grids(spark, sf):
    """Every other scene as big-endian grids named by its degree; nodata comes back as NULL, bounds by the name.

    A grid holds 16 bits, which heights may exceed: one grid has a height's remainder, another how often it goes over. A remainder
    that no height has marks pixels that the scene lacks. Degrees come again after 180 scenes, so that names also tell the turn.
    The two grids of a scene meet tile by tile, by shuffles only: what pixels are made of is in no estimate of their size.
    """

    @F.pandas_udf("binary")
    def packed(at: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for where, values in zip(at, rows):
            plane = np.full(demo.SIDE * demo.SIDE, HGT_ABSENT, ">i2")
            if np.any(np.abs(values) > -files.HGT_NODATA):
                raise OverflowError("a height beyond two grids of 16 bits")
            plane[where] = values
            out.append(plane.tobytes())
        return pd.Series(out)

    px = demo.orders_raster(spark, sf).withColumn("k", F.substring("scene_id", 2, 18).cast("int")).filter("k % 2 = 0")
    height = F.when(F.col("label") != demo.NODATA, (F.get("bands", F.lit(1)) - 500).cast("int"))
    parts = {"low": F.pmod(height, F.lit(HGT_SPAN)) - HGT_SPAN // 2, "high": F.floor(height / HGT_SPAN)}
    pixel = F.struct((F.col("y") * demo.SIDE + F.col("x")).alias("at"), *[F.coalesce(v.cast("int"), F.lit(files.HGT_NODATA)).alias(n) for n, v in parts.items()])
    name = F.format_string("N%02dW%03d_%d", F.col("k") % 90, F.col("k") % 180, F.floor(F.col("k") / 180))
    scenes = files.stored(px.groupBy("k").agg(F.collect_list(pixel).alias("p")).select(name.alias("name"), "p"))
    grids = [scenes.select(F.concat("name", F.lit(f"_{n}.hgt")).alias("path"), F.col("p.at").alias("at"), F.col(f"p.{n}").alias("v")) for n in parts]
    root = _scratch(spark)
    _act(files.write_files(files.spread(grids[0].unionByName(grids[1])).select("path", packed("at", "v").alias("content")), root))
    tiles = files.read_elevation(spark, root, demo.SIDE, rows_per_tile=20).filter("error IS NULL")
    one = [F.max(F.when(F.endswith("scene_id", F.lit(f"_{n}")), F.col("data"))).alias(n) for n in parts]
    met = tiles.groupBy(F.substring_index("scene_id", "_", 2).alias("scene_id"), "tile_row", "tile_col", "min_x", "min_y", "max_x", "max_y").agg(*one)
    both = F.flatten(F.zip_with("low", "high", lambda low, high: F.array(low, high)))
    px = grid.tiles_to_pixels(met.select("*", F.lit(2).alias("n_bands"), both.alias("data")))
    low, high = [F.get("bands", F.lit(n)).cast("double") for n in range(2)]
    out = files.elevation_bounds(px.filter(low != HGT_ABSENT), demo.SIDE)
    height = high * HGT_SPAN + low + HGT_SPAN // 2
    return out.select(F.col("bounds.min_y").alias("min_y"), F.col("bounds.min_x").alias("min_x"), "y", "x", F.nanvl(height, F.lit(None).cast("double")).alias("height"), "pixel_size")


@register("ras006_unpacked_archives", """
SELECT p_brand || '/' || p_partkey || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '/m.txt' END AS path, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey || ',' || p_name END AS text, p_partkey % 10 = 0 AS failed FROM part""")
def unpacked_archives(spark, sf):
    """An archive for each part in a folder for each brand; a broken one is a row of the report. The output mirrors the input's folders."""

    @F.pandas_udf("binary")
    def archive(content: pd.Series) -> pd.Series:
        return _member(content)

    p = files.spread(demo.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name"))
    text = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name")
    root = _scratch(spark)
    _act(files.write_files(p.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".zip")).alias("path"), archive(text).alias("content")), root))
    rows = files.unpacked_paths(files.unpack(spark, root), root)
    return rows.select("path", F.col("content").cast("string").alias("text"), F.col("error").isNotNull().alias("failed"))


@register("ras007_header_files", "SELECT s_suppkey::VARCHAR AS scene_id, s_nationkey::DOUBLE AS sun, 9 AS lines FROM supplier")
def header_files(spark, sf):
    """One text file in a folder for each scene, read whole."""
    root = _scratch(spark)
    texts = files.spread(_mtl(spark, sf))
    _act(files.write_files(texts.select(F.concat("scene_id", F.lit("/header.txt")).alias("path"), F.col("text").cast("binary").alias("content")), root))
    headers = files.stored(files.read_headers(spark, root, level=1))
    sun = catalog.scalar_tag(catalog.header_lines(headers), "SUN_ELEVATION", "sun")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("lines")
    return headers.select("scene_id", lines).join(sun, "scene_id")


@register("ras002_missing_from_list", "SELECT DISTINCT 'img' || o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_from_list(spark, sf):
    wanted = demo.table(spark, sf, "orders").select(F.concat(F.lit("img"), F.col("o_custkey").cast("string")).alias("path")).distinct()
    found = demo.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("img"), F.col("c_custkey").cast("string")).alias("path"))
    return catalog.missing(wanted, found, "path")


@register("ras003_label_id_list", "SELECT p_name AS label_id FROM part WHERE p_size % 2 = 0")
def label_id_list(spark, sf):
    first = F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("id")
    return files.label_ids(demo.table(spark, sf, "part").select(F.concat_ws(", ", first, "p_name").alias("value")))


@register("ras009_catalog_pages", "SELECT event_id::VARCHAR AS scene_id, (json_extract(props, '$.k'))::BIGINT AS k, 'platform:' || event_type AS summary FROM events")
def catalog_pages(spark, sf):
    """Result pages of 1,000 scenes, one JSON document each, written as files and read as one table."""
    e = demo.table(spark, sf, "events")
    scene = F.struct(F.col("event_id").cast("string").alias("displayId"), F.concat(F.lit("platform:"), "event_type").alias("summary"), F.from_json("props", "k long").alias("meta"))
    pages = e.groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.collect_list(scene).alias("results"))
    root = _scratch(spark)
    name = F.concat(F.lit("page"), F.col("page").cast("string"), F.lit(".json"))
    _act(files.write_files(pages.select(name.alias("path"), F.to_json(F.struct(F.struct("results").alias("data"))).cast("binary").alias("content")), root))
    rows = files.read_catalog(spark, root).select(F.explode("data.results").alias("s"))
    return rows.select(F.col("s.displayId").alias("scene_id"), F.col("s.meta.k").alias("k"), F.col("s.summary").alias("summary"))


@register("ras013_not_done_yet", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def not_done_yet(spark, sf):
    done = demo.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") > 25).alias("valid"))
    return catalog.not_done(demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), done, "id")


@register("ras014_pair_labels", f"SELECT stem || '.tiff' AS path, CASE WHEN l.doc_id IS NOT NULL THEN stem || '_label.tiff' END AS label_path FROM ({PATHS}) d LEFT JOIN labels l USING (doc_id)")
def pair_labels(spark, sf):
    return catalog.pair_labels(_image_paths(spark, sf), _label_paths(spark, sf), ".tiff", "_label.tiff")


@register("ras015_drop_labels", f"SELECT stem || '.tiff' AS path FROM ({PATHS})")
def drop_labels(spark, sf):
    return catalog.drop_labels_among_images(_image_paths(spark, sf).unionByName(_label_paths(spark, sf)), "_label.tiff")


@register("ras016_size_mismatches", "SELECT s_suppkey AS id, s_nationkey % 5 AS image_h, s_suppkey % 5 AS label_h FROM supplier WHERE s_nationkey % 5 <> s_suppkey % 5")
def size_mismatches(spark, sf):
    s = demo.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("image_h"), F.lit(1).alias("image_w"), (F.col("s_suppkey") % 5).alias("label_h"), F.lit(1).alias("label_w"))
    return catalog.size_mismatches(s).select("id", "image_h", "label_h")


@register("ras017_invalid_inputs", """
SELECT vec_id::VARCHAR AS scene_id, CASE vec_id % 5 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'no pixels' ELSE 'missing' END AS reason FROM embeddings WHERE vec_id % 5 < 4""")
def invalid_inputs(spark, sf):
    """Files that are empty, hold no array, hold one without rows, or were never written; the rest is decoded."""

    @F.pandas_udf("binary")
    def saved(rows: pd.Series, kind: pd.Series) -> pd.Series:
        out = []
        for r, k in zip(rows, kind):
            b = io.BytesIO()
            np.save(b, np.asarray(r, np.float32).reshape(8, 8)[: 0 if k == 2 else 8])
            out.append(b"" if k == 0 else b"no array" if k == 1 else b.getvalue())
        return pd.Series(out)

    e = demo.table(spark, sf, "embeddings")
    root = _scratch(spark)
    name = F.concat(F.lit("a/"), F.col("vec_id").cast("string"), F.lit(".npy"))
    _act(files.write_files(files.spread(e.filter("vec_id % 5 <> 3")).select(name.alias("path"), saved("embedding", F.col("vec_id") % 5).alias("content")), root))
    found = files.invalid_inputs(files.discover(spark, root, "npy"), files.read_npy(spark, root), e.select(F.col("vec_id").cast("string").alias("scene_id")))
    return found.select("scene_id", F.when(F.col("reason").isin("no pixels", "missing"), F.col("reason")).otherwise("unreadable").alias("reason"))


@register("ras018_missing_companions", "SELECT o_orderkey || '_B' || b.k AS path FROM orders, range(1, 5) b(k) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = b.k)")
def missing_companions(spark, sf):
    name = lambda k, b: F.concat(F.col(k).cast("string"), F.lit("_B"), F.col(b).cast("string")).alias("path")
    wanted = demo.table(spark, sf, "orders").withColumn("b", F.explode(F.array(*map(F.lit, range(1, 5))))).select(name("o_orderkey", "b"))
    return catalog.missing(wanted, demo.table(spark, sf, "lineitem").select(name("l_orderkey", "l_linenumber")), "path")


@register("ras019_part_count", "SELECT l_suppkey AS scene_id, max(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END)::INT AS parts FROM lineitem GROUP BY l_suppkey")
def part_count(spark, sf):
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit("_part.tif"))).otherwise(F.concat(F.lit("9_"), F.col("l_linenumber").cast("string"), F.lit("_x.tif")))
    return catalog.part_count(demo.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("scene_id"), name.alias("name")), "scene_id")


def _mtl(spark, sf):
    s = demo.table(spark, sf, "supplier")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    lines = [F.concat(F.lit("  SUN_ELEVATION = "), nation)]
    lines += [F.concat(F.lit(f"  {t}_BAND_{b} = \""), (s["s_suppkey"] / 10.0).cast("string"), F.lit('"')) for t in ("RADIANCE_MULT", "K1_CONSTANT") for b in ("1", "6_VCID_1", "X")]
    lines.append(F.concat(F.lit("FILE_NAME_BAND_1 = "), key, F.lit("_B1.TIF")))
    return s.select(key.alias("scene_id"), F.concat_ws("\n", F.lit("GROUP"), *lines).alias("text"))


@register("ras020_mtl_header", """
SELECT s_suppkey::VARCHAR AS scene_id, 0 AS band, s_suppkey / 10.0::DOUBLE AS radiance, s_suppkey / 10.0::DOUBLE AS k1, s_suppkey || '_B1.TIF' AS file, s_nationkey::DOUBLE AS sun FROM supplier
UNION ALL SELECT s_suppkey::VARCHAR, 6, s_suppkey / 10.0::DOUBLE, s_suppkey / 10.0::DOUBLE, NULL, s_nationkey FROM supplier""")
def mtl_header(spark, sf):
    """Coefficients as numbers; of the file names only band 1 has one."""
    lines = catalog.header_lines(_mtl(spark, sf))
    rows = catalog.mtl_coefficients(lines).join(catalog.scalar_tag(lines, "SUN_ELEVATION", "sun"), "scene_id")
    return rows.select("scene_id", "band", F.col("RADIANCE_MULT").alias("radiance"), F.col("K1_CONSTANT").alias("k1"), F.col("FILE_NAME").alias("file"), "sun")


@register("ras021_imd_header", "SELECT s_suppkey::VARCHAR AS scene_id, b.k::INT AS band, s_suppkey + b.k / 10.0::DOUBLE AS abscal, (b.k + 1)::DOUBLE AS bandwidth FROM supplier, range(3) b(k)")
def imd_header(spark, sf):
    s = demo.table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    lines = [F.concat(F.lit("absCalFactor = "), key, F.lit(f".{b};\neffectiveBandwidth = {b + 1};")) for b in range(3)]
    return catalog.imd_coefficients(catalog.header_lines(s.select(key.alias("scene_id"), F.concat_ws("\n", *lines).alias("text"))))


@register("ras022_scene_names", """
SELECT event_id, substr(event_type, 1, 3) AS sensor, lpad((user_id % 1000)::VARCHAR, 3, '0') AS path, lpad((event_id % 1000)::VARCHAR, 3, '0') AS row, CAST(ts AS DATE)::VARCHAR AS acquired,
       substr(event_type, 1, 4) AS wv_sensor, CAST(ts AS DATE)::VARCHAR AS wv_acquired FROM events""")
def scene_names(spark, sf):
    """Names of both kinds, dates as dates."""
    e = demo.table(spark, sf, "events")
    pad = lambda c: F.lpad((F.col(c) % 1000).cast("string"), 3, "0")
    day = F.date_format("ts", "yyyyMMdd")
    name = F.concat_ws("_", F.substring("event_type", 1, 3), F.lit("L1"), F.concat(pad("user_id"), pad("event_id")), day)
    other = F.concat_ws("_", F.concat(F.substring("event_type", 1, 4), F.lit("N42")), F.lit("939570W073"), F.concat(F.lit("252079"), day, F.lit("00000000MS00")), F.lit("GU004003002"))
    rows = e.select("event_id", catalog.landsat_name(name).alias("n"), catalog.worldview_name(other).alias("w"))
    return rows.select("event_id", "n.sensor", "n.path", "n.row", F.col("n.acquired").cast("string").alias("acquired"), F.col("w.sensor").alias("wv_sensor"), F.col("w.acquired").cast("string").alias("wv_acquired"))


@register("ras023_sensor_bands", """
SELECT p_partkey AS id, CASE WHEN contains(p_brand, '5') OR contains(p_brand, '7') THEN '1,2,3,4,5,6,7' WHEN contains(p_brand, '8') THEN '1,2,3,4,5,6,7,9' ELSE '' END AS bands FROM part""")
def sensor_bands(spark, sf):
    return demo.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(catalog.sensor_bands(F.col("p_brand")), lambda b: b.cast("string")), ",").alias("bands"))


@register("ras024_elevation_names", """
SELECT c_custkey AS id, (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 180))::INT AS min_x, (CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 60))::INT AS min_y FROM customer""")
def elevation_names(spark, sf):
    c = demo.table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "N").otherwise("S"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 2 == 0, "E").otherwise("W"), F.lpad((k % 180).cast("string"), 3, "0"))
    b = catalog.elevation_tile_bounds(name)
    return c.select(k.alias("id"), b["min_x"].alias("min_x"), b["min_y"].alias("min_y"))


@register("ras025_wanted_events", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(text), 'heit')) AND NOT (contains(lower(text), 'mit') OR contains(lower(text), 'que')) AND n_chars % 3 > 0")
def wanted_events(spark, sf):
    rows = demo.table(spark, sf, "documents").withColumn("open", F.col("n_chars") % 3 > 0)
    return catalog.wanted_events(rows, "text", ["tion", "heit"], ["mit", "que"], "open").select("doc_id")


@register("ras026_wanted_scenes", """
SELECT o_orderkey::VARCHAR AS scene_id FROM orders WHERE o_orderstatus IN ('F', 'O') AND substr(o_orderpriority, 1, 1) IN ('1', '2') AND (o_custkey % 3 = 0 OR o_custkey % 20 >= 8)
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 2) AND o_custkey % 11 > 0""")
def wanted_scenes(spark, sf):
    """Platform and sensor in any case, a list of names, entities required."""
    o = demo.table(spark, sf, "orders")
    field = F.struct(F.lit("bands").alias("name"), (F.col("o_custkey") % 20).cast("string").alias("value"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("scene_id"), F.when(F.col("o_custkey") % 11 > 0, F.concat(F.lit("e"), F.col("o_custkey").cast("string"))).alias("entity_id"),
                    F.concat(F.lit("Entity: x, Platform: World"), "o_orderstatus", F.lit(", SENSOR: ms"), F.substring("o_orderpriority", 1, 1), F.lit(", cloud: 1")).alias("summary"),
                    F.when(F.col("o_custkey") % 3 != 0, F.array(field)).otherwise(F.array().cast("array<struct<name:string,value:string>>")).alias("fields"))
    line = demo.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("scene_id"), "l_quantity", "l_linenumber")
    return catalog.wanted_scenes(rows, [("worldf", "MS1"), ("WorldF", "ms2"), ("worldo", "ms1"), ("worldo", "ms2")], line.filter("l_quantity >= 49"), names=line.filter("l_linenumber >= 2")).select("scene_id")


SPLIT = _u(3, "stem", "'.tiff'").replace("':' || '.tiff'", "'.tiff'")


@register("ras027_random_split", f"""
WITH p AS (SELECT doc_id, stem, stem || '.tiff' AS path FROM ({PATHS}) WHERE doc_id % 3 <> 1), f AS (SELECT * FROM p ORDER BY md5('3:first:' || path), path LIMIT 500)
SELECT path, CASE WHEN l.doc_id IS NOT NULL THEN stem || '_label.tiff' END AS label_path, CASE WHEN {SPLIT} < 0.3 THEN 'validation' ELSE 'train' END AS split FROM f LEFT JOIN labels l USING (doc_id)""")
def random_split(spark, sf):
    """Images of a list, 500 at most (the feature's limit); labels go where their image goes."""
    pairs = catalog.pair_labels(_image_paths(spark, sf), _label_paths(spark, sf), ".tiff", "_label.tiff")
    listed = demo.table(spark, sf, "documents").filter("doc_id % 3 <> 1").select(F.concat(F.lit("img"), F.col("doc_id").cast("string")).alias("stem"))
    return catalog.random_split(pairs, "path", 0.3, 3, listed, 500)


@register("ras028_mirrored_paths", f"SELECT stem || '.tiff' AS path, 'out/' || split_part(stem, '/', 2) || '/P_' || split_part(stem, '/', 3) || '.tiff' AS output FROM ({PATHS})")
def mirrored_paths(spark, sf):
    return _image_paths(spark, sf).select("path", catalog.mirrored_path(F.col("path"), "data", "out", "P_").alias("output"))


@register("ras029_labels_on_date", """
WITH e AS (SELECT *, CAST(ts AS DATE) AS date, user_id * 4 AS x FROM events), t AS (SELECT event_id AS label_id, date, x, event_id * 7 % 20 AS y FROM e WHERE event_type IN ('click', 'view')),
m AS (SELECT e.event_id AS scene_id, label_id, row_number() OVER (PARTITION BY e.event_id ORDER BY label_id) AS n FROM e JOIN t ON t.date = e.date
      AND t.x < e.x + 60 AND t.x + 12 > e.x AND t.y < e.event_id % 20 + 12 AND t.y + 8 > e.event_id % 20 WHERE e.event_type NOT IN ('click', 'view'))
SELECT scene_id, label_id FROM m WHERE n <= 12""")
def labels_on_date(spark, sf):
    """Clicks and views are label tiles, other events scenes; the plane grows with the users."""
    scenes, labels = demo.event_boxes(spark, sf)
    return catalog.labels_on_date(scenes, labels, 16)


def _labelled_tiles(spark, sf):
    t = demo.embedding_tiles(spark, sf)
    return t.select("scene_id", F.lit(8).alias("height"), F.lit(8).alias("width"), "n_bands", "data", F.transform("data", lambda v: (v > 0).cast("int")).alias("labels"))


CHUNKS = """c AS (SELECT vec_id::VARCHAR AS scene_id, r.k::INT AS chunk_row, c.k::INT AS chunk_col, embedding AS e, 2 * r.k AS y, 2 * c.k AS x FROM embeddings, range(3) r(k), range(3) c(k)),
chunks AS (SELECT scene_id, chunk_row, chunk_col, (SELECT round(sum(e[(y + i // 4) * 8 + x + i % 4 + 1]::DOUBLE), 4) FROM range(16) t(i)) AS total,
    (e[(y + 1) * 8 + x + 2] > 0)::INT || ',' || (e[(y + 1) * 8 + x + 3] > 0)::INT || ',' || (e[(y + 2) * 8 + x + 2] > 0)::INT || ',' || (e[(y + 2) * 8 + x + 3] > 0)::INT AS label FROM c)"""


def _chunk_rows(spark, sf):
    return sampling.chunks(_labelled_tiles(spark, sf), 4, 2, 2)


def _shown(df):
    total = F.round(F.aggregate("image", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    return df.select("scene_id", "chunk_row", "chunk_col", total.alias("total"), F.array_join(F.transform("label", lambda v: v.cast("string")), ",").alias("label"))


@register("ras073_chunks", f"WITH {CHUNKS} SELECT * FROM chunks")
def chunks(spark, sf):
    return _shown(_chunk_rows(spark, sf))


@register("ras074_pair_samples", f"WITH {CHUNKS} SELECT * FROM chunks")
def pair_samples(spark, sf):
    rows = _chunk_rows(spark, sf)
    key = ["scene_id", "chunk_row", "chunk_col"]
    return _shown(sampling.pair_samples(rows.select(*key, "image"), rows.select(*key, "label"), key))


@register("ras075_drop_empty_samples", f"WITH {CHUNKS} SELECT * FROM chunks WHERE label <> '1,1,1,1'")
def drop_empty_samples(spark, sf):
    return _shown(sampling.drop_empty(_chunk_rows(spark, sf), 1))


OFFSET = f"o AS (SELECT (floor({_u(5, chr(39) + '2' + chr(39), chr(39) + 'x' + chr(39))} * 9) - 4)::INT AS dx, (floor({_u(5, chr(39) + '2' + chr(39), chr(39) + 'y' + chr(39))} * 9) - 4)::INT AS dy)"


@register("ras076_epoch_offset", f"WITH {demo.PX}, {OFFSET} SELECT a.scene_id, a.y, a.x, coalesce(b.v, 0) AS value, coalesce(b.label, 2) AS label FROM px a CROSS JOIN o LEFT JOIN px b ON b.scene_id = a.scene_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx")
def epoch_offset(spark, sf):
    dx, dy = sampling.epoch_offset(5, 2, 4)
    return sampling.shifted(_value_label(spark, sf), dx, dy, {"label": demo.NODATA})


def _value_label(spark, sf):
    return demo.orders_raster(spark, sf).select(*KEY, F.get("bands", F.lit(0)).alias("value"), "label")


def _numbered(spark, sf, epoch):
    s = demo.table(spark, sf, "embeddings").select("vec_id", "label")
    return sampling.numbered(s, sampling.shuffle_key(1, epoch, "vec_id"), ["vec_id"])


POSITION = "p AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('1:{0}:' || vec_id), vec_id) - 1 AS position FROM embeddings)"


@register("ras077_shuffled_order", f"WITH {POSITION.format(4)} SELECT vec_id, position FROM p")
def shuffled_order(spark, sf):
    return _numbered(spark, sf, 4).select("vec_id", "position")


@register("ras078_batches", f"WITH {POSITION.format(0)} SELECT vec_id, (position // 32)::INT AS batch, e.k::INT AS epoch FROM p, range(2) e(k) WHERE position // 32 < least(10, (SELECT count(*) // 32 FROM p))")
def batches(spark, sf):
    return sampling.batches(_numbered(spark, sf, 0), 32, steps=10, epochs=2).select("vec_id", "batch", "epoch")


@register("ras079_hold_out", f"WITH {POSITION.format(0)} SELECT vec_id, CASE WHEN position < 50 THEN 'validation' ELSE 'train' END AS split FROM p")
def hold_out(spark, sf):
    return sampling.hold_out(_numbered(spark, sf, 0), 50).select("vec_id", "split")


@register("ras080_autoencoder_pairs", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS image, round(list_sum(embedding::DOUBLE[]), 4) AS target FROM embeddings")
def autoencoder_pairs(spark, sf):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    return sampling.autoencoder_pairs(demo.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("image"))).select("vec_id", total("image").alias("image"), total("label").alias("target"))


Q = chr(39)


@register("ras081_flips", f"""WITH {demo.PX} SELECT scene_id, CASE WHEN {_u(9, Q + 'ud' + Q, 'scene_id')} <= 0.5 THEN 49 - y ELSE y END AS y, CASE WHEN {_u(9, Q + 'lr' + Q, 'scene_id')} <= 0.5 THEN 49 - x ELSE x END AS x, label FROM px""")
def flips(spark, sf):
    return sampling.flips(demo.orders_raster(spark, sf).select(*KEY, "label"), demo.SIDE, demo.SIDE, 0.5, 9)


def _moved_sql(name: str, sources: str) -> str:
    """SQL of ``sampling.moved``: ``sources`` gives sy and sx, before they are mirrored into 50 x 50."""
    return f"""
WITH {demo.PX}, d AS (SELECT DISTINCT scene_id FROM px), {sources},
s AS (SELECT scene_id, y, x, ((sy % 98) + 98) % 98 AS ry, ((sx % 98) + 98) % 98 AS rx FROM t)
SELECT s.scene_id, s.y, s.x, b.v AS value, b.label FROM s JOIN px b ON b.scene_id = s.scene_id AND b.x = CASE WHEN rx < 50 THEN rx ELSE 98 - rx END AND b.y = CASE WHEN ry < 50 THEN ry ELSE 98 - ry END"""


MOVE = f"""o AS (SELECT scene_id, {_u(9, Q + 'move?' + Q, 'scene_id')} <= 0.7 AS go, (floor({_u(9, Q + 'dx' + Q, 'scene_id')} * 21) - 10)::INT AS dx, (floor({_u(9, Q + 'dy' + Q, 'scene_id')} * 21) - 10)::INT AS dy FROM d),
t AS (SELECT px.scene_id, y, x, y - CASE WHEN go THEN dy ELSE 0 END AS sy, x - CASE WHEN go THEN dx ELSE 0 END AS sx FROM px JOIN o USING (scene_id))"""


@register("ras082_translate", _moved_sql("translate", MOVE))
def translate(spark, sf):
    return sampling.translated(_value_label(spark, sf), demo.SIDE, demo.SIDE, 10, 9, probability=0.7)


TURN = f"""o AS (SELECT scene_id, CASE WHEN {_u(9, Q + 'turn?' + Q, 'scene_id')} <= 0.8 THEN radians((2 * {_u(9, Q + 'angle' + Q, 'scene_id')} - 1) * 20) ELSE 0 END AS a FROM d),
t AS (SELECT px.scene_id, y, x, floor(cos(a) * (y - 24.5) - sin(a) * (x - 24.5) + 24.5 + 0.5)::INT AS sy, floor(sin(a) * (y - 24.5) + cos(a) * (x - 24.5) + 24.5 + 0.5)::INT AS sx FROM px JOIN o USING (scene_id))"""


@register("ras083_rotate", _moved_sql("rotate", TURN.replace("24.5", "24.5::DOUBLE")))
def rotate(spark, sf):
    """Bands and labels turned together, each scene by its own angle of at most 20 degrees."""
    return sampling.rotated(_value_label(spark, sf), demo.SIDE, demo.SIDE, 20.0, 9, probability=0.8)


@register("ras084_brightness", f"WITH {demo.PX} SELECT scene_id, y, x, round(CASE WHEN {_u(9, Q + 'light?' + Q, 'scene_id')} <= 0.6 THEN v * (0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * {_u(9, Q + 'light' + Q, 'scene_id')}) ELSE v END, 4) AS value, label FROM px")
def brightness(spark, sf):
    return sampling.brightened(_value_label(spark, sf), 0.6, 9, 0.8, 1.2).withColumn("value", F.round("value", 4)).select(*KEY, "value", "label")


@register("ras085_augmentation_chain", f"""
WITH {demo.PX}, d AS (SELECT DISTINCT scene_id FROM px), f AS (SELECT scene_id, CASE WHEN {_u(9, Q + 'ud' + Q, 'scene_id')} <= 1 THEN 49 - y ELSE y END AS y, 49 - x AS x, v, label FROM px),
o AS (SELECT scene_id, {_u(4, Q + 'move?' + Q, 'scene_id')} <= 0.7 AS go, (floor({_u(4, Q + 'dx' + Q, 'scene_id')} * 21) - 10)::INT AS dx, (floor({_u(4, Q + 'dy' + Q, 'scene_id')} * 21) - 10)::INT AS dy FROM d),
s AS (SELECT f.*, (((y - CASE WHEN go THEN dy ELSE 0 END) % 98) + 98) % 98 AS ry, (((x - CASE WHEN go THEN dx ELSE 0 END) % 98) + 98) % 98 AS rx FROM f JOIN o USING (scene_id))
SELECT s.scene_id, s.y, s.x, round(CASE WHEN {_u(5, Q + 'light?' + Q, 's.scene_id')} <= 0.5 THEN b.v * (0.5::DOUBLE + (1.5::DOUBLE - 0.5::DOUBLE) * {_u(5, Q + 'light' + Q, 's.scene_id')}) ELSE b.v END, 4) AS value, b.label
FROM s JOIN f b ON b.scene_id = s.scene_id AND b.x = CASE WHEN rx < 50 THEN rx ELSE 98 - rx END AND b.y = CASE WHEN ry < 50 THEN ry ELSE 98 - ry END""")
def augmentation_chain(spark, sf):
    """Flip, then translate, then change the brightness, by the names of the registry."""
    size = {"width": demo.SIDE, "height": demo.SIDE}
    steps = [{"random_flip": {**size, "probability": 1.0, "seed": 9}}, {"random_translate": {**size, "most": 10, "seed": 4, "probability": 0.7}}, {"random_brightness": {"probability": 0.5, "seed": 5}}]
    return sampling.augment(_value_label(spark, sf), steps).withColumn("value", F.round("value", 4)).select(*KEY, "value", "label")


AUGMENTED = f"""
WITH {demo.PX}, b AS (SELECT scene_id, y // 10 AS chunk_row, x // 10 AS chunk_col, y % 10 AS y, x % 10 AS x, px.v, label FROM px),
full_ AS (SELECT scene_id, chunk_row, chunk_col FROM b GROUP BY ALL HAVING count(*) = 100),
k AS (SELECT f.*, e.k AS epoch, e.k || ':' || scene_id || ':' || chunk_row || ':' || chunk_col AS key FROM full_ f, range(2) e(k)),
d AS (SELECT *, {_u(7, Q + '0-go' + Q, 'key')} <= 0.5 AS lr, {_u(7, Q + '1-go' + Q, 'key')} <= 0.5 AS ud, {_u(7, Q + '2-go' + Q, 'key')} <= 0.7 AS moves,
    (floor({_u(7, Q + '2-dx' + Q, 'key')} * 7) - 3)::INT AS dx, (floor({_u(7, Q + '2-dy' + Q, 'key')} * 7) - 3)::INT AS dy,
    CASE WHEN {_u(7, Q + '3-go' + Q, 'key')} <= 0.8 THEN radians((2 * {_u(7, Q + '3-angle' + Q, 'key')} - 1) * 20) ELSE 0 END AS a,
    CASE WHEN {_u(7, Q + '4-go' + Q, 'key')} <= 0.6 THEN 0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * {_u(7, Q + '4-light' + Q, 'key')} ELSE 1 END AS light FROM k),
p AS (SELECT d.*, y.k AS y, x.k AS x, floor(cos(a) * (y.k - 4.5::DOUBLE) - sin(a) * (x.k - 4.5::DOUBLE) + 4.5::DOUBLE + 0.5::DOUBLE)::INT AS ry, floor(sin(a) * (y.k - 4.5::DOUBLE) + cos(a) * (x.k - 4.5::DOUBLE) + 4.5::DOUBLE + 0.5::DOUBLE)::INT AS rx FROM d, range(10) y(k), range(10) x(k)),
q AS (SELECT *, ((ry % 18) + 18) % 18 AS my, ((rx % 18) + 18) % 18 AS mx FROM p),
m AS (SELECT *, CASE WHEN my < 10 THEN my ELSE 18 - my END - CASE WHEN moves THEN dy ELSE 0 END AS ty, CASE WHEN mx < 10 THEN mx ELSE 18 - mx END - CASE WHEN moves THEN dx ELSE 0 END AS tx FROM q),
n AS (SELECT *, ((ty % 18) + 18) % 18 AS uy, ((tx % 18) + 18) % 18 AS ux FROM m),
s AS (SELECT *, CASE WHEN uy < 10 THEN uy ELSE 18 - uy END AS sy, CASE WHEN ux < 10 THEN ux ELSE 18 - ux END AS sx FROM n)
SELECT s.epoch::INT AS epoch, s.scene_id, s.chunk_row::INT AS chunk_row, s.chunk_col::INT AS chunk_col, s.y::INT AS y, s.x::INT AS x, round(b.v * light, 4) AS value, b.label
FROM s JOIN b ON b.scene_id = s.scene_id AND b.chunk_row = s.chunk_row AND b.chunk_col = s.chunk_col AND b.y = CASE WHEN ud THEN 9 - sy ELSE sy END AND b.x = CASE WHEN lr THEN 9 - sx ELSE sx END"""


@register("ras085_augmented_samples", AUGMENTED)
def augmented_samples(spark, sf):
    """Samples of 10 x 10, image and label, flipped, moved, turned and brightened anew in each of two epochs."""
    px = demo.orders_raster(spark, sf)
    cells = px.groupBy("scene_id", F.floor(F.col("y") / 10).cast("int").alias("chunk_row"), F.floor(F.col("x") / 10).cast("int").alias("chunk_col"))
    made = cells.agg(F.array_sort(F.collect_list(F.struct("y", "x", F.get("bands", F.lit(0)).alias("v"), "label"))).alias("_p")).filter(F.size("_p") == 100)
    samples = made.select("scene_id", "chunk_row", "chunk_col", F.transform("_p", lambda p: p["v"]).alias("image"), F.transform("_p", lambda p: p["label"]).alias("label"))
    steps = [{"random_flip_left_right": {"probability": 0.5}}, {"random_flip_up_down": {"probability": 0.5}}, {"random_translate": {"probability": 0.7, "max_pixels": 3}}, {"random_rotate": {"probability": 0.8, "max_angle": 20}}, {"random_brightness": {"probability": 0.6, "min_factor": 0.8, "max_factor": 1.2}}]
    out = sampling.augment_samples(samples, steps, ["scene_id", "chunk_row", "chunk_col"], (10, 10), seed=7, epochs=2)
    out = out.select("epoch", "scene_id", "chunk_row", "chunk_col", F.posexplode(F.arrays_zip("image", "label")).alias("_at", "_p"))
    return out.select("epoch", "scene_id", "chunk_row", "chunk_col", F.floor(F.col("_at") / 10).cast("int").alias("y"), (F.col("_at") % 10).alias("x"), F.round("_p.image", 4).alias("value"), "_p.label")


def _scratch(spark) -> str:
    return os.path.join(files.shared_folder(spark), f"scratch-{uuid.uuid4().hex}")


@register("ras013_resumed_batch", f"""
WITH {demo.PX}, g AS (SELECT scene_id, substr(scene_id, 2)::INT AS k, count(*) AS pixels, count(*) FILTER (v >= 250000) AS bright FROM px GROUP BY scene_id)
SELECT scene_id, pixels, bright, k % 2 = 1 OR k % 4 = 0 AS in_second_run, false AS in_third_run FROM g""")
def resumed_batch(spark, sf):
    """Every other scene was done before the batch was stopped, and some of these have lost rows since: the second run works on
    the missing and the damaged ones, the third on none."""
    base = _scratch(spark)
    px = demo.orders_raster(spark, sf).withColumn("k", F.substring("scene_id", 2, 18).cast("int"))

    def work(rows):
        return rows.select("scene_id", "y", "x", (F.get("bands", F.lit(0)) >= 250000).alias("bright"))

    batch.resume(spark, px.filter("k % 2 = 0"), base, work)
    work(px.filter("k % 2 = 0 AND (k % 4 <> 0 OR y < 3)")).write.mode("overwrite").parquet(f"{base}/scenes/attempt=0")
    runs = []
    for name in ("in_second_run", "in_third_run"):
        done = batch.resume(spark, px, base, work).withColumn(name, F.lit(True))
        done.write.parquet(f"{base}/{name}")
        runs.append(spark.read.schema(done.schema).parquet(f"{base}/{name}"))
    out = batch.results(spark, base).groupBy("scene_id").agg(F.count(F.lit(1)).alias("pixels"), F.count(F.when(F.col("bright"), 1)).alias("bright"))
    return out.join(runs[0], "scene_id", "left").join(runs[1], "scene_id", "left").fillna(False)


@register("ras006_unpacked_tree", "SELECT p_brand || '/' || p_partkey || '/m.txt' AS path, octet_length(encode(p_partkey || ',' || p_name)) AS length FROM part WHERE p_partkey % 10 <> 0")
def unpacked_tree(spark, sf):
    """Members of all archives written from their ranges to a tree that mirrors the archives' folders."""

    @F.pandas_udf("binary")
    def archive(content: pd.Series) -> pd.Series:
        return _member(content)

    p = files.spread(demo.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name"))
    text = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name")
    root, out = _scratch(spark), _scratch(spark)
    _act(files.write_files(p.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".zip")).alias("path"), archive(text).alias("content")), root))
    _act(files.unpack_to(spark, root, out))
    found = files.listed(spark, out)
    return found.select(F.concat_ws("/", F.slice(F.split("path", "/"), -3, 3)).alias("path"), "length")


@register("ras012_write_and_read_tiles", f"""
WITH {demo.PX}, t AS (SELECT scene_id, substr(scene_id, 2)::INT AS k, (y // 16)::INT AS tile_row, (x // 16)::INT AS tile_col, count(*) AS pixels, sum(px.v)::DECIMAL(18, 2)::VARCHAR AS total FROM px GROUP BY ALL)
SELECT scene_id, tile_row, tile_col, pixels, total, -1.0::DOUBLE AS nodata, k * 25 + tile_col * 8.0::DOUBLE AS corner_x, 100 - tile_row * 4.0::DOUBLE AS corner_y, CASE WHEN k % 4 <> 1 THEN 'EPSG:32610' END AS projection FROM t""")
def write_and_read_tiles(spark, sf):
    """Tiles with nodata, geotransform and projection, read back as pixels."""
    path = _scratch(spark)
    files.write_tiles(demo.orders_raster(spark, sf).select(*KEY, "bands"), path, 16, nodata=-1.0, headers=demo.order_headers(spark, sf))
    tiles = spark.read.parquet(path)
    px = grid.tiles_to_pixels(tiles).withColumns({"tile_row": F.floor(F.col("y") / 16).cast("int"), "tile_col": F.floor(F.col("x") / 16).cast("int")})
    sums = px.groupBy("scene_id", "tile_row", "tile_col").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.get("bands", F.lit(0)).cast("decimal(18,2)")).cast("decimal(18,2)").cast("string").alias("total"))
    return sums.join(tiles.select("scene_id", "tile_row", "tile_col", "nodata", F.col("gt")[0].alias("corner_x"), F.col("gt")[3].alias("corner_y"), "projection"), ["scene_id", "tile_row", "tile_col"])


@register("ras093_new_scenes_stream", "SELECT o_orderkey AS id, o_totalprice / 1024 AS value FROM orders")
def new_scenes_stream(spark, sf):
    base = _scratch(spark)
    stream = streams.read_stream(spark, sf, demo.table(spark, sf, "orders").schema, pattern="orders.parquet")
    streams.process_new(stream.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1024).alias("value")), f"{base}/out", f"{base}/check").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("ras094_running_confusion", f"WITH {demo.PX} SELECT label AS true_class, (v >= 250000)::INT AS pred_class, count(*) AS n FROM px WHERE label < 2 GROUP BY ALL")
def running_confusion(spark, sf):
    base = _scratch(spark)
    stream = streams.read_stream(spark, sf, demo.table(spark, sf, "orders").schema, pattern="orders.parquet")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(demo.NODATA)
    blocks = stream.select(label.alias("label"), (F.col("o_totalprice") >= 250000).cast("int").alias("pred"))
    streams.latest(streams.running_confusion(blocks, "label", "pred", demo.NODATA), f"{base}/out", f"{base}/check").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("ras097_scene_reports_stream", evaluation_queries.SQL["ras097_class_report_rollup"])
def scene_reports_stream(spark, sf):
    """Tiles of all scenes in shuffled order over several triggers, every third one twice; each scene reports once, when it is whole."""
    base = _scratch(spark)
    px = demo.orders_raster(spark, sf).withColumn("pred", (demo.probability() >= 0.5).cast("int"))
    tiles = px.groupBy("scene_id", F.floor(F.col("y") / 10).cast("int").alias("tile_row"), F.floor(F.col("x") / 10).cast("int").alias("tile_col")).agg(F.collect_list(F.struct("label", "pred")).alias("_p"))
    number = tiles.groupBy("scene_id").agg(F.count(F.lit(1)).cast("int").alias("n_tiles"))
    order = F.xxhash64("scene_id", "tile_row", "tile_col")
    tiles = tiles.join(number, "scene_id").select("scene_id", "tile_row", "tile_col", "n_tiles", F.transform("_p", lambda p: p["label"]).alias("labels"), F.transform("_p", lambda p: p["pred"]).alias("preds"), order.alias("_order"))
    twice = tiles.unionByName(tiles.filter("_order % 3 = 0").withColumn("_order", F.xxhash64("_order")))
    twice.repartition(6, "_order").drop("_order").write.parquet(f"{base}/tiles")
    stream = streams.read_stream(spark, f"{base}/tiles", spark.read.parquet(f"{base}/tiles").schema, files_per_trigger=2)
    streams.process_new(streams.scene_confusion(stream, 2, demo.NODATA), f"{base}/out", f"{base}/check").awaitTermination()
    conf = evaluate.with_totals(spark.read.parquet(f"{base}/out"), "scene_id")
    report = evaluate.class_report(conf, "scene_id")
    return report.withColumns({n: F.round(n, 6) for n in ("precision", "recall", "frequency", "accuracy")})


@register("ras128_registry", f"""
WITH {demo.PX}, m AS (SELECT scene_id, 49 - x AS x, 49 - y AS y, px.v / 2 + 1 AS v, label FROM px)
SELECT scene_id, count(*) AS n, round(avg(CASE WHEN label = 1 THEN (v > 100001)::INT END), 6) AS recall, round(sum(v * (x + 1)), 1) AS weighted FROM m GROUP BY scene_id""")
def registry_steps(spark, sf):
    """Steps, an augmentation and a metric by their names."""
    bands = F.col("bands")
    for spec in ({"scale": {"factor": 2}}, {"offset": {"factor": 1}}):
        bands = registry.make("preprocess", spec, bands)
    px = demo.orders_raster(spark, sf).select(*KEY, F.get(bands, F.lit(0)).alias("v"), "label")
    px = registry.make("augmentation", {"random_flip": {"width": demo.SIDE, "height": demo.SIDE, "probability": 1.0, "seed": 3}}, px)
    recall = registry.make("metric", {"recall": {"cls": 1}}, F.col("label"), (F.col("v") > 100001).cast("int"))
    return px.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.round(recall, 6).alias("recall"), F.round(F.sum(F.col("v") * (F.col("x") + 1)), 1).alias("weighted"))
