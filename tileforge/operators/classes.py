"""Class tables: codes, names, colours and weights of the label values, always small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The colours of classes that name none, in their order; further ones are black.
PALETTE = (0x1F77B4, 0xFF7F0E, 0x2CA02C, 0xD62728, 0x9467BD, 0x8C564B, 0xE377C2, 0x7F7F7F, 0xBCBD22, 0x17BECF)


def class_rows(spec: int | list | dict) -> list[tuple[int, int, str, int, float | None]]:
    """(idx, value, name, color, weight), by value.

    ``spec`` is a number n of classes 0..n-1, or a list or dict of value -> {name, color, weight} (a bare number in a list is
    a class of that value). Weights are given for all classes or for none.
    """
    if isinstance(spec, int):
        items = [(v, {}) for v in range(spec)]
    elif isinstance(spec, dict):
        items = list(spec.items())
    else:
        items = [(c, {}) if isinstance(c, int) else next(iter(c.items())) for c in spec]
    rows = [(int(v), (o or {}).get("name", f"Class {v}"), (o or {}).get("color"), (o or {}).get("weight")) for v, o in items]
    if len({v for v, *_ in rows}) != len(rows):
        raise ValueError("a class value comes twice")
    if len({w is None for *_, w in rows}) > 1:
        raise ValueError("weights must be given for all classes or for none")
    ordered = sorted(rows, key=lambda r: r[0])
    return [(k, v, n, (PALETTE[k] if k < len(PALETTE) else 0) if c is None else int(c), w) for k, (v, n, c, w) in enumerate(ordered)]


def class_table(spark: SparkSession, spec: int | list | dict) -> DataFrame:
    return spark.createDataFrame(class_rows(spec), "idx int, value int, name string, color int, weight double")


def class_table_from_values(rows: DataFrame, value: str) -> DataFrame:
    """The class table of the values that occur; their number must be small."""
    from pyspark.sql import Window

    found = rows.select(F.col(value).cast("int").alias("value")).filter(F.col("value").isNotNull()).distinct()
    ranked = found.withColumn("idx", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))
    colour = F.coalesce(F.get(F.array(*map(F.lit, PALETTE)), F.col("idx")), F.lit(0))
    return ranked.select("idx", "value", F.concat(F.lit("Class "), F.col("value").cast("string")).alias("name"), colour.alias("color"))


def to_index(rows: DataFrame, classes: DataFrame, value: str, out: str) -> DataFrame:
    """The rank of the value among the classes; values that are no class stay as they are."""
    known = F.broadcast(classes.select(F.col("value").alias("_value"), F.col("idx").alias("_idx")))
    return rows.join(known, F.col(value) == F.col("_value"), "left").withColumn(out, F.coalesce(F.col("_idx"), F.col(value).cast("int"))).drop("_value", "_idx")


def to_value(rows: DataFrame, classes: DataFrame, index: str, out: str) -> DataFrame:
    """The inverse of ``to_index``."""
    known = F.broadcast(classes.select(F.col("idx").alias("_idx"), F.col("value").alias("_value")))
    return rows.join(known, F.col(index) == F.col("_idx"), "left").withColumn(out, F.coalesce(F.col("_value"), F.col(index).cast("int"))).drop("_value", "_idx")


def with_nodata_index(index: Column, raw: Column, nodata: int | None, n_classes: int) -> Column:
    """The index one past the classes where the raw value is nodata."""
    return index if nodata is None else F.when(raw == nodata, F.lit(n_classes)).otherwise(index)


def class_weights(index: Column, weights: list[float]) -> Column:
    """The weight of the class; nodata (one past the classes) weighs 0."""
    return F.get(F.array(*[F.lit(float(w)) for w in weights], F.lit(0.0)), index)


def class_id(rows: list, wanted: int | str) -> int:
    """The index of a class by value, name, or ``nodata``."""
    for idx, value, name, *_ in rows:
        if wanted in (value, name):
            return idx
    if wanted == "nodata":
        return len(rows)
    raise ValueError(f"no class {wanted}")
