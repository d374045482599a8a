"""Confusion matrices, class reports, class metrics and losses as aggregates.

Counts are algebraic, so Spark combines them before the shuffle; results have one row per scene and class pair at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPSILON = 1e-7


def confusion(rows: DataFrame, true: str, pred: str, classes: int, nodata: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, true_class, pred_class, n) with zero cells; pixels that are nodata or NULL on either side do not count.

    The cells of all classes are few: they are made from the keys that occur, by exploding two short sequences.
    """
    valid = rows.filter(F.col(true).isNotNull() & F.col(pred).isNotNull())
    if nodata is not None:
        valid = valid.filter((F.col(true) != nodata) & (F.col(pred) != nodata))
    counts = valid.groupBy(*keys, F.col(true).cast("int").alias("true_class"), F.col(pred).cast("int").alias("pred_class")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")) if keys else counts.agg(F.count(F.lit(1)).alias("_k"))
    numbers = F.sequence(F.lit(0), F.lit(classes - 1))
    cells = named.withColumn("true_class", F.explode(numbers)).withColumn("pred_class", F.explode(numbers)).drop("_k")
    return cells.join(counts, [*keys, "true_class", "pred_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_totals(conf: DataFrame, key: str) -> DataFrame:
    """Adds the rows of all keys together, with a NULL key, in the same pass."""
    return conf.rollup("true_class", "pred_class", key).agg(F.sum("n").alias("n")).filter("true_class IS NOT NULL AND pred_class IS NOT NULL")


def class_report(conf: DataFrame, *keys: str) -> DataFrame:
    """(keys, cls, precision, recall, frequency, accuracy) in percent, 0 where a denominator is 0."""
    w = {c: Window.partitionBy(*keys, c) for c in ("true_class", "pred_class")}
    rows = conf.withColumns({"_row": F.sum("n").over(w["true_class"]), "_col": F.sum("n").over(w["pred_class"])})
    rows = rows.groupBy(*keys, F.col("true_class").alias("cls")).agg(
        F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)).alias("hit"),
        F.max("_row").alias("_row"), F.max(F.when(F.col("true_class") == F.col("pred_class"), F.col("_col"))).alias("_col"))
    all_ = Window.partitionBy(*keys)

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(100 * F.try_divide(a, b), F.lit(0.0))

    total = F.sum("_row").over(all_)
    return rows.select(*keys, "cls", share(F.col("hit"), F.col("_col")).alias("precision"), share(F.col("hit"), F.col("_row")).alias("recall"), share(F.col("_row"), total).alias("frequency"), share(F.sum("hit").over(all_), total).alias("accuracy"))


def confusion_percent(conf: DataFrame, *keys: str) -> DataFrame:
    return conf.withColumn("percent", F.coalesce(100 * F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))), F.lit(0.0)))


def recall_of(true: Column, pred: Column, cls: int) -> Column:
    """Aggregate: hits over true pixels of the class, 0 where there is none."""
    return F.coalesce(F.try_divide(F.sum(((true == cls) & (pred == cls)).cast("long")), F.sum((true == cls).cast("long"))), F.lit(0.0))


def precision_of(true: Column, pred: Column, cls: int, nodata: int) -> Column:
    """Aggregate: hits over predicted pixels of the class whose label is not nodata, 0 where there is none."""
    seen = (pred == cls) & (true != nodata)
    return F.coalesce(F.try_divide(F.sum((seen & (true == cls)).cast("long")), F.sum(seen.cast("long"))), F.lit(0.0))


def accuracy_of(true: Column, pred: Column, cls: int, nodata: int) -> Column:
    """Aggregate: valid pixels where truth and prediction agree on being the class, over valid pixels; NULL without any."""
    valid = true != nodata
    return F.try_divide(F.sum((valid & ((true == cls) == (pred == cls))).cast("long")), F.sum(valid.cast("long")))


def map_labels(label: Column, mapping: list, nodata: int) -> tuple[Column, Column]:
    """(target, valid): the class's scalar or vector; nodata, and classes mapped to ``nodata``, become 0 and invalid."""
    if any(m is None for m in mapping):
        raise ValueError("every class must be mapped")
    sizes = {len(m) if isinstance(m, (list, tuple)) else 0 for m in mapping if m != "nodata"}
    if len(sizes) != 1:
        raise ValueError("all entries must be scalars, or vectors of one length")
    n = sizes.pop()
    zero = F.array(*[F.lit(0.0)] * n) if n else F.lit(0.0)
    entry = lambda m: zero if m == "nodata" else F.array(*[F.lit(float(v)) for v in m]) if n else F.lit(float(m))
    bad = (label == nodata) | F.coalesce(F.get(F.array(*[F.lit(m == "nodata") for m in mapping]), label), F.lit(True))
    return F.when(bad, zero).otherwise(F.get(F.array(*map(entry, mapping)), label)), ~bad


def zeroed(p: Column, valid: Column) -> Column:
    """The prediction, or each of an array of them, with 0 where it does not count."""
    return F.when(valid, p).otherwise(0.0)


def zeroed_each(p: Column, valid: Column) -> Column:
    return F.transform(p, lambda v: zeroed(v, valid))


def _clipped(p: Column) -> Column:
    return F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), p))


def binary_cross_entropy(t: Column, p: Column) -> Column:
    """Per value; invalid values zeroed before still count."""
    q = _clipped(p)
    return -(t * F.log(q) + (1 - t) * F.log(1 - q))


def categorical_cross_entropy(t: Column, p: Column) -> Column:
    """Of two arrays; probabilities are divided by their sum first."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    terms = F.zip_with(t, p, lambda a, b: -a * F.log(_clipped(F.coalesce(F.try_divide(b, total), F.lit(0.0)))))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def focal_loss(t: Column, p: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Sigmoid focal loss per value."""
    q = _clipped(p)
    right = t * q + (1 - t) * (1 - q)
    return (t * alpha + (1 - t) * (1 - alpha)) * F.pow(1 - right, F.lit(gamma)) * -F.log(right)


def dice_loss(t: Column, p: Column) -> Column:
    """Aggregate over the values of a tile."""
    return 1 - (2 * F.sum(F.abs(t * p)) + 1) / (F.sum(t * t) + F.sum(p * p) + 1 + EPSILON)


def weighted_sum(losses: list[Column], weights: list[float] | None = None) -> Column:
    out = F.lit(0.0)
    for loss, w in zip(losses, weights or [1.0] * len(losses)):
        out = out + w * loss
    return out


def pooled(loss: Column, n: Column) -> Column:
    """Aggregate over blocks: their losses weighted by their sizes."""
    return F.try_divide(F.sum(loss * n), F.sum(n))


def flagship(spark: SparkSession, pixels: DataFrame, true: str, pred: str, classes: int, nodata: int) -> DataFrame:
    """The class report of every scene and, with a NULL scene, of all."""
    conf = with_totals(confusion(pixels, true, pred, classes, nodata, ("scene_id",)), "scene_id")
    return class_report(conf, "scene_id")
