"""Queries over confusion matrices, metrics, losses and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import align, evaluate, scoring, stats
from . import demo

QUERIES: dict = {}
SQL: dict[str, str] = {}
N = demo.NODATA
T, D = "true_class", "pred_class"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _scored(spark, sf):
    px = demo.orders_raster(spark, sf).withColumn("p", demo.probability())
    return px.withColumn("pred", P.decide(F.array("p"), binary=True))


BASE = f"""{demo.PX}, q AS (SELECT *, v / 500000 AS p, (v / 500000 >= 0.5)::INT AS pred FROM px),
cells AS (SELECT s.scene_id, t.k AS true_class, d.k AS pred_class FROM (SELECT DISTINCT scene_id FROM q WHERE label < 2) s, range(2) t(k), range(2) d(k)),
conf AS (SELECT c.scene_id, c.true_class::INT AS true_class, c.pred_class::INT AS pred_class, count(q.label) AS n
         FROM cells c LEFT JOIN q ON q.scene_id = c.scene_id AND q.label = c.true_class AND q.pred = c.pred_class GROUP BY ALL),
both_ AS (SELECT * FROM conf UNION ALL SELECT NULL, true_class, pred_class, sum(n)::BIGINT FROM conf GROUP BY true_class, pred_class)"""


def _conf(spark, sf):
    return evaluate.confusion(_scored(spark, sf), "label", "pred", 2, N, ("scene_id",))


@register("ras092_confusion", f"WITH {BASE} SELECT * FROM conf")
def confusion(spark, sf):
    return _conf(spark, sf).select("scene_id", T, D, "n")


REPORT = """SELECT {k} true_class AS cls, coalesce(100 * (sum(n) FILTER (true_class = pred_class)) / nullif(any_value(col), 0)::DOUBLE, 0) AS precision,
    coalesce(100 * (sum(n) FILTER (true_class = pred_class)) / nullif(sum(n), 0)::DOUBLE, 0) AS recall, coalesce(100 * sum(n) / nullif(any_value(total), 0)::DOUBLE, 0) AS frequency,
    coalesce(100 * any_value(hits) / nullif(any_value(total), 0)::DOUBLE, 0) AS accuracy
FROM (SELECT t.*, c.col, s.total, s.hits FROM {t} t
      JOIN (SELECT scene_id AS cs, pred_class AS cp, sum(n) AS col FROM {t} GROUP BY ALL) c ON c.cs IS NOT DISTINCT FROM t.scene_id AND c.cp = t.true_class
      JOIN (SELECT scene_id AS ss, sum(n) AS total, sum(n) FILTER (true_class = pred_class) AS hits FROM {t} GROUP BY ALL) s ON s.ss IS NOT DISTINCT FROM t.scene_id) GROUP BY ALL"""


def _report_sql(of: str, round_: bool = True) -> str:
    inner = REPORT.format(k="scene_id,", t=of)
    return f"WITH {BASE} SELECT scene_id, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(frequency, 6) AS frequency, round(accuracy, 6) AS accuracy FROM ({inner})"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("ras095_class_report", _report_sql("conf"))
def class_report(spark, sf):
    return _rounded(evaluate.class_report(_conf(spark, sf), "scene_id"), "precision", "recall", "frequency", "accuracy")


@register("ras097_class_report_rollup", _report_sql("both_"))
def class_report_rollup(spark, sf):
    return _rounded(evaluate.flagship(spark, _scored(spark, sf), "label", "pred", 2, N), "precision", "recall", "frequency", "accuracy")


@register("ras096_confusion_percent", f"WITH {BASE} SELECT scene_id, true_class, pred_class, n, round(100 * n / (sum(n) OVER (PARTITION BY scene_id))::DOUBLE, 6) AS percent FROM conf")
def confusion_percent(spark, sf):
    return _rounded(evaluate.confusion_percent(_conf(spark, sf), "scene_id"), "percent").select("scene_id", T, D, "n", "percent")


@register("ras099_recall", f"WITH {BASE} SELECT scene_id, round(coalesce(sum((label = 1 AND pred = 1)::INT) / nullif(sum((label = 1)::INT), 0)::DOUBLE, 0), 6) AS value FROM q GROUP BY scene_id")
def recall(spark, sf):
    return _scored(spark, sf).groupBy("scene_id").agg(F.round(evaluate.recall_of(F.col("label"), F.col("pred"), 1), 6).alias("value"))


@register("ras100_precision", f"WITH {BASE} SELECT scene_id, round(coalesce(sum((label = 1 AND pred = 1)::INT) / nullif(sum((label < 2 AND pred = 1)::INT), 0)::DOUBLE, 0), 6) AS value FROM q GROUP BY scene_id")
def precision(spark, sf):
    return _scored(spark, sf).groupBy("scene_id").agg(F.round(evaluate.precision_of(F.col("label"), F.col("pred"), 1, N), 6).alias("value"))


@register("ras101_binary_accuracy", f"WITH {BASE} SELECT scene_id, round(sum((label < 2 AND label = pred)::INT) / nullif(sum((label < 2)::INT), 0)::DOUBLE, 6) AS value FROM q GROUP BY scene_id")
def binary_accuracy(spark, sf):
    return _scored(spark, sf).groupBy("scene_id").agg(F.round(evaluate.accuracy_of(F.col("label"), F.col("pred"), 1, N), 6).alias("value"))


@register("ras102_mapped_labels", f"""
WITH {demo.PX} SELECT scene_id, y, x, CASE priority WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0 END AS target, priority IN (0, 1, 2) AS valid,
    CASE priority WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0 END AS first, CASE priority WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.75::DOUBLE ELSE 0 END AS second,
    CASE WHEN priority IN (0, 1, 2) THEN v / 500000 ELSE 0 END AS p FROM px""")
def mapped_labels(spark, sf):
    """Classes to scalars and to vectors; what is nodata zeroes truth and prediction."""
    target, valid = evaluate.map_labels(F.col("priority"), [0.0, 1.0, 0.5, "nodata"], 4)
    vector, held = evaluate.map_labels(F.col("priority"), [[1.0, 0.0], [0.0, 1.0], [0.25, 0.75], "nodata"], 4)
    p = evaluate.zeroed_each(F.array(demo.probability()), held)
    return demo.orders_raster(spark, sf).select("scene_id", "y", "x", target.alias("target"), valid.alias("valid"), vector[0].alias("first"), vector[1].alias("second"), F.get(p, F.lit(0)).alias("p"))


def _mapped(spark, sf):
    target, valid = evaluate.map_labels(F.col("label"), [0.0, 1.0], N)
    px = demo.orders_raster(spark, sf).withColumns({"t": target, "valid": valid, "tile": F.floor(F.col("y") / 10).cast("int")})
    return px.withColumn("p", evaluate.zeroed(demo.probability(), F.col("valid")))


LOSS = f"""{demo.PX}, m AS (SELECT scene_id, y // 10 AS tile, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0 END AS t, CASE WHEN label < 2 THEN v / 500000 ELSE 0 END AS p FROM px),
l AS (SELECT *, least(1 - 1e-7::DOUBLE, greatest(1e-7::DOUBLE, p)) AS q FROM m)"""
BCE = "-(t * ln(q) + (1 - t) * ln(1 - q))"
FOCAL = "(t * 0.25::DOUBLE + (1 - t) * 0.75::DOUBLE) * pow(1 - (t * q + (1 - t) * (1 - q)), 2) * -ln(t * q + (1 - t) * (1 - q))"
DICE = "1 - (2 * sum(abs(t * p)) + 1) / (sum(t * t) + sum(p * p) + 1 + 1e-7::DOUBLE)"


@register("ras103_binary_cross_entropy", f"WITH {LOSS} SELECT scene_id, round(avg({BCE}), 6) AS loss FROM l GROUP BY scene_id")
def binary_cross_entropy(spark, sf):
    return _mapped(spark, sf).groupBy("scene_id").agg(F.round(F.avg(evaluate.binary_cross_entropy(F.col("t"), F.col("p"))), 6).alias("loss"))


@register("ras104_categorical_cross_entropy", f"WITH {demo.SCORES} SELECT label, round(avg(-ln(least(1 - 1e-7::DOUBLE, greatest(1e-7::DOUBLE, probs[label + 1] / list_sum(probs))))), 6) AS loss FROM scores GROUP BY label")
def categorical_cross_entropy(spark, sf):
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k == F.col("label")).cast("double"))
    return demo.class_scores(spark, sf).groupBy("label").agg(F.round(F.avg(evaluate.categorical_cross_entropy(hot, F.col("probs"))), 6).alias("loss"))


@register("ras105_dice", f"WITH {LOSS} SELECT scene_id, tile::INT AS tile, round({DICE}, 6) AS loss FROM l GROUP BY scene_id, tile")
def dice(spark, sf):
    return _mapped(spark, sf).groupBy("scene_id", "tile").agg(F.round(evaluate.dice_loss(F.col("t"), F.col("p")), 6).alias("loss"))


@register("ras106_focal_loss", f"WITH {LOSS} SELECT scene_id, round(avg({FOCAL}), 6) AS loss FROM l GROUP BY scene_id")
def focal(spark, sf):
    return _mapped(spark, sf).groupBy("scene_id").agg(F.round(F.avg(evaluate.focal_loss(F.col("t"), F.col("p"))), 6).alias("loss"))


@register("ras107_weighted_losses", f"WITH {LOSS} SELECT scene_id, round(0.7::DOUBLE * avg({BCE}) + 0.3::DOUBLE * avg({FOCAL}), 6) AS loss FROM l GROUP BY scene_id")
def weighted_losses(spark, sf):
    t, p = F.col("t"), F.col("p")
    mixed = evaluate.weighted_sum([F.avg(evaluate.binary_cross_entropy(t, p)), F.avg(evaluate.focal_loss(t, p))], [0.7, 0.3])
    return _mapped(spark, sf).groupBy("scene_id").agg(F.round(mixed, 6).alias("loss"))


@register("ras108_pooled_loss", f"WITH {LOSS}, d AS (SELECT scene_id, tile, {DICE} AS loss, count(*) AS n FROM l GROUP BY scene_id, tile) SELECT scene_id, round(sum(loss * n) / sum(n), 6) AS loss FROM d GROUP BY scene_id")
def pooled_loss(spark, sf):
    tiles = _mapped(spark, sf).groupBy("scene_id", "tile").agg(evaluate.dice_loss(F.col("t"), F.col("p")).alias("d"), F.count(F.lit(1)).alias("n"))
    return tiles.groupBy("scene_id").agg(F.round(evaluate.pooled(F.col("d"), F.col("n")), 6).alias("loss"))


def _tile_pairs(spark, sf):
    e = demo.table(spark, sf, "embeddings")
    a = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("b"))
    return a.join(b, "vec_id")


PAIRS = """cells AS (SELECT a.vec_id, i, (i // 8) AS y, (i % 8) AS x, a.embedding[i + 1]::DOUBLE AS a, b.embedding[i + 1]::DOUBLE AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(64) t(i))"""


@register("ras109_ms_ssim_loss", f"""
WITH {PAIRS}, m AS (SELECT vec_id, avg(a) AS ma, avg(b) AS mb, avg((a - b) * (a - b)) AS mse FROM cells GROUP BY vec_id),
s AS (SELECT vec_id, mse, 1 - pow(greatest((2 * ma * mb + 0.0016::DOUBLE) / (ma * ma + mb * mb + 0.0016::DOUBLE), 0), 0.1333::DOUBLE) AS loss FROM m)
SELECT vec_id, round(loss, 5) AS loss, round(loss + mse, 5) AS loss_mse FROM s""")
def ms_ssim_loss(spark, sf):
    """Of neighbouring 8 x 8 tiles, without and with the mean square error. On tiles so small the filter has one cell."""
    pairs = _tile_pairs(spark, sf)
    both = scoring.ms_ssim_mse_loss(scoring.ms_ssim_loss(pairs, 8), 8, "loss_mse")
    return both.select("vec_id", F.round("loss", 5).alias("loss"), F.round("loss_mse", 5).alias("loss_mse"))


@register("ras110_surface_loss", f"""
WITH {PAIRS}, d AS (
    SELECT c.vec_id, c.i, any_value(c.a > 0) AS t, 1 / (1 + exp(-any_value(c.b))) AS p, count(*) FILTER (o.a > 0) AS ones, count(*) FILTER (NOT o.a > 0) AS zeros,
           sqrt(min((c.y - o.y) * (c.y - o.y) + (c.x - o.x) * (c.x - o.x)) FILTER (o.a > 0)) AS d1, sqrt(min((c.y - o.y) * (c.y - o.y) + (c.x - o.x) * (c.x - o.x)) FILTER (NOT o.a > 0)) AS d0
    FROM cells c JOIN cells o USING (vec_id) GROUP BY c.vec_id, c.i
)
SELECT vec_id, round(avg(p * CASE WHEN zeros = 0 THEN 0 WHEN NOT t THEN CASE WHEN ones > 0 THEN 1 - d1 ELSE 0 END ELSE d0 END
    + (1 - p) * CASE WHEN ones = 0 THEN 0 WHEN t THEN CASE WHEN zeros > 0 THEN 1 - d0 ELSE 0 END ELSE d1 END), 6) AS loss FROM d GROUP BY vec_id""")
def surface_loss(spark, sf):
    """Boundary loss of one tile's sign mask against the next tile's values, squeezed to 0..1."""
    pairs = _tile_pairs(spark, sf).select("vec_id", F.transform("a", lambda x: (x > 0).cast("double")).alias("a"), F.transform("b", lambda x: 1 / (1 + F.exp(-x))).alias("b"))
    return scoring.surface_loss(pairs, 8).select("vec_id", F.round("loss", 6).alias("loss"))


STATS = """SELECT l_suppkey AS scene_id, band::INT AS band, min(v) AS lowest, max(v) AS highest, avg(v) AS mean, stddev_pop(v) AS deviation
FROM (SELECT l_suppkey, unnest([0, 1, 2, 3]) AS band, unnest([l_quantity, l_extendedprice, nullif(l_discount, 0), l_tax + 0.0]) AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY l_suppkey, band"""


def _rounded_stats(df):
    return df.withColumns({c: F.round(c, 4) for c in ("lowest", "highest", "mean", "deviation")})


R4 = "round(lowest, 4) AS lowest, round(highest, 4) AS highest, round(mean, 4) AS mean, round(deviation, 4) AS deviation"


@register("ras111_band_statistics", f"SELECT scene_id, band, {R4} FROM ({STATS})")
def band_statistics(spark, sf):
    return _rounded_stats(stats.band_statistics(demo.line_observations(spark, sf)))


@register("ras112_average_statistics", f"SELECT band, {R4} FROM (SELECT band, avg(lowest) AS lowest, avg(highest) AS highest, avg(mean) AS mean, avg(deviation) AS deviation FROM ({STATS}) GROUP BY band)")
def average_statistics(spark, sf):
    return _rounded_stats(stats.average_statistics(stats.band_statistics(demo.line_observations(spark, sf))))


@register("ras113_class_shares", f"""
WITH {demo.PX}, c AS (SELECT scene_id, label, count(*) AS n FROM px GROUP BY ALL), b AS (SELECT * FROM c UNION ALL SELECT NULL, label, sum(n)::BIGINT FROM c GROUP BY label)
SELECT scene_id, label, n, round(n / (CASE WHEN label = 2 THEN sum(n) OVER s ELSE sum(CASE WHEN label <> 2 THEN n ELSE 0 END) OVER s END)::DOUBLE, 6) AS share FROM b WINDOW s AS (PARTITION BY scene_id)""")
def class_shares(spark, sf):
    return _rounded(stats.class_shares(demo.orders_raster(spark, sf), N), "share").select("scene_id", "label", "n", "share")


@register("ras114_band_histogram", f"""
WITH {demo.PX}, c AS (SELECT scene_id, least(v / 100000, 2.0) AS v FROM px), r AS (SELECT scene_id, min(v) AS lo, max(v) AS hi FROM c GROUP BY scene_id)
SELECT scene_id, least(coalesce(floor((v - lo) * 200 / nullif(hi - lo, 0)), 0), 199)::INT AS bin, count(*) AS n FROM c JOIN r USING (scene_id) GROUP BY ALL""")
def band_histogram(spark, sf):
    px = demo.orders_raster(spark, sf).withColumn("bands", F.transform("bands", lambda b: b / 100000))
    return stats.band_histogram(px, 0)


@register("ras115_difference", f"WITH {demo.PX} SELECT scene_id, y, x, floor(least(255, ((0.1::DOUBLE * v / 100000) * (0.1::DOUBLE * v / 100000) + (0.1::DOUBLE * w / 100000) * (0.1::DOUBLE * w / 100000)) / 2 * 128))::INT AS diff FROM px")
def difference(spark, sf):
    px = demo.orders_raster(spark, sf)
    a, b = px.withColumn("bands", F.transform("bands", lambda x: 0.1 * x / 100000)), px.withColumn("bands", F.transform("bands", lambda x: x * 0))
    return align.difference(a, b)
