"""Exact cases for pixel expressions, class tables and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from tileforge.functions import pixels as P
from tileforge.operators import classes as C
from tileforge.operators import evaluate, registry, stats


def test_chain(spark):
    df = spark.createDataFrame([([0.0, 2.0, -5.0, 20.0, None],)], "bands array<double>")
    steps = [{"scale": {"factor": 2}}, {"offset": {"factor": 1}}, {"clip": {"bounds": [0, 5]}}]
    assert df.select(P.chain(F.col("bands"), steps)).first()[0] == [1.0, 2.0, 0.0, 5.0, None]
    with pytest.raises(ValueError):
        P.chain(F.col("bands"), ["no such step"])
    with pytest.raises(ValueError):
        P.scale(F.col("bands"), image_type="npy")


def test_bytes_of_a_ramp(spark):
    ramp = spark.range(100).select((F.col("id") / 100.0).alias("p")).withColumn("label", (F.col("p") >= 0.5).cast("int"))
    for r in ramp.select("p", "label", P.probability_byte(F.col("p")).alias("a"), P.error_byte(F.col("p"), F.col("label")).alias("b"), P.absolute_error_byte(F.col("p"), F.col("label")).alias("c")).collect():
        assert r.a == 1 + min(254, int(r.p * 254))
        assert r.b == max(1, min(255, math.floor((r.p - r.label) * 127 + 128)))
        assert r.c == max(1, min(255, math.floor(abs(r.p - r.label) * 254 + 1)))


def test_class_table(spark):
    rows = C.class_rows({2: {"weight": 5.0}, 1: {"weight": 1.0}, 5: {"weight": 2.0}})
    assert [r[1] for r in rows] == [1, 2, 5] and [r[4] for r in rows] == [1.0, 5.0, 2.0]
    assert C.class_id(rows, 5) == 2 and C.class_id(rows, "nodata") == 3
    table = C.class_table(spark, {2: {}, 1: {}, 5: {}})
    px = spark.createDataFrame([(1,), (2,), (5,), (9,)], "v int")
    there = C.to_value(C.to_index(px, table, "v", "i"), table, "i", "back")
    assert sorted(map(tuple, there.select("v", "i", "back").collect())) == [(1, 0, 1), (2, 1, 2), (5, 2, 5), (9, 9, 9)]
    with pytest.raises(ValueError):
        C.class_rows({1: {"weight": 1.0}, 2: {}})


def test_toa(spark):
    df = spark.createDataFrame([([0.0, 10.0], [2.0, 3.0], [1.0, 4.0], [600.0, 700.0], [1200.0, 1300.0])], "b array<double>, m array<double>, a array<double>, k1 array<double>, k2 array<double>")
    b, m, a, k1, k2 = (F.col(c) for c in ("b", "m", "a", "k1", "k2"))
    row = df.select(P.toa_radiance(b, m, a), P.toa_temperature(b, m, a, k1, k2), P.toa_reflectance(b, m, a, F.lit(30.0))).first()
    assert row[0] == [0.0, 34.0]
    assert row[1][0] == 0.0 and row[1][1] == pytest.approx(1300 / math.log(700 / 34 + 1))
    assert row[2][0] == 0.0 and row[2][1] == pytest.approx(68.0)


def test_confusion_keeps_zero_cells_and_drops_nodata(spark):
    px = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("a", None, 1)], "scene_id string, t int, p int")
    conf = evaluate.confusion(px, "t", "p", 2, 2, ("scene_id",))
    assert sorted((r.true_class, r.pred_class, r.n) for r in conf.collect()) == [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)]
    report = {r.cls: r for r in evaluate.class_report(conf, "scene_id").collect()}
    assert report[0].precision == report[1].recall == report[0].accuracy == 100 and report[0].frequency == 50


def test_metrics_without_pixels(spark):
    px = spark.createDataFrame([(0, 0)], "t int, p int")
    row = px.agg(evaluate.recall_of(F.col("t"), F.col("p"), 1), evaluate.precision_of(F.col("t"), F.col("p"), 1, 2), evaluate.accuracy_of(F.col("t"), F.col("p"), 1, 0)).first()
    assert tuple(row) == (0.0, 0.0, None)


def test_histogram_of_one_value(spark):
    px = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("a", [-1.0])], "scene_id string, bands array<double>")
    assert [tuple(r) for r in stats.band_histogram(px, 0).collect()] == [("a", 0, 2)]


def test_registry(spark):
    registry.register("preprocess", "double", lambda b: F.transform(b, lambda x: x * 2))
    df = spark.createDataFrame([([1.0],)], "bands array<double>")
    assert df.select(registry.make("preprocess", "double", F.col("bands"))).first()[0] == [2.0]
    with pytest.raises(ValueError):
        registry.find("loss", "no such loss")
