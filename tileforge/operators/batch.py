"""Batches over scenes that go on where they stopped: output by run, a mark for each scene that is whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _sums(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, more, rows, sum): how many rows a scene has, and a sum over their contents that does not depend on their order."""
    columns = sorted(c for c in rows.columns if c not in (key, *more))
    return rows.groupBy(F.col(key).cast("string").alias(key), *more).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*columns)).alias("sum"))


def _marks(spark: SparkSession, output: str, key: str) -> DataFrame | None:
    """(_key, _attempt, _rows, _sum): the newest mark of each scene."""
    marks = _read(spark, f"{output}/marks")
    if marks is None:
        return None
    newest = marks.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct("attempt", "rows", "sum")).alias("_m"))
    return newest.select("_key", *[F.col(f"_m.{n}").alias(f"_{n}") for n in ("attempt", "rows", "sum")])


def finished(spark: SparkSession, output: str, key: str = "scene_id") -> DataFrame | None:
    """(key) of the scenes whose output is there as their newest mark says; None if there is no output yet."""
    made, marks = _read(spark, f"{output}/scenes"), _marks(spark, output, key)
    if made is None or marks is None:
        return None
    there = _sums(made, key, "attempt")
    met = marks.join(there, F.col(key).eqNullSafe(F.col("_key")) & (F.col("attempt") == F.col("_attempt")), "left")
    whole = (F.coalesce("rows", F.lit(0)) == F.col("_rows")) & (F.coalesce("sum", F.lit(0)) == F.col("_sum"))
    return met.filter(whole).select(F.col("_key").alias(key))


def results(spark: SparkSession, output: str, key: str = "scene_id") -> DataFrame:
    """The rows of all scenes that have a mark, of the run that marked them last; what has been lost since is known to ``finished``."""
    marks = _marks(spark, output, key).select("_key", "_attempt")
    rows = spark.read.parquet(f"{output}/scenes")
    same = F.col(key).cast("string").eqNullSafe(F.col("_key")) & (F.col("attempt") == F.col("_attempt"))
    return rows.join(marks, same, "left_semi").drop("attempt")


def resume(spark: SparkSession, inputs: DataFrame, output: str, work: Callable[[DataFrame], DataFrame], key: str = "scene_id") -> DataFrame:
    """(key) of the scenes that this run worked on: those of ``inputs`` whose output is missing or damaged.

    ``work`` makes rows of the inputs' rows and keeps their key, a scene by itself. Rows are written to a folder of this run,
    ``output``/scenes/attempt=n, all scenes together, so that folders are as many as runs; then each scene's count and sum are read back
    and become its mark in ``output``/marks/attempt=n. A run that ends between the two leaves rows without marks: its folder is
    replaced by the next run, which works on these scenes again. ``results`` reads what counts, and nothing is there twice.
    """
    done = finished(spark, output, key)
    keys = inputs.select(F.col(key).cast("string").alias("_key")).distinct()
    keys = keys if done is None else keys.join(done, F.col("_key").eqNullSafe(F.col(key)), "left_anti")
    keys.write.mode("overwrite").parquet(f"{output}/round")
    keys = spark.read.schema(keys.schema).parquet(f"{output}/round")
    if not keys.isEmpty():
        marks = _read(spark, f"{output}/marks")
        last = None if marks is None else marks.agg(F.max("attempt")).first()[0]
        n = 0 if last is None else last + 1
        todo = inputs.join(keys, F.col(key).cast("string").eqNullSafe(F.col("_key")), "left_semi")
        work(todo).write.mode("overwrite").parquet(f"{output}/scenes/attempt={n}")
        sums = _sums(spark.read.parquet(f"{output}/scenes/attempt={n}"), key)
        marked = keys.join(sums, F.col("_key").eqNullSafe(F.col(key)), "left")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "sum")]
        marked.select(F.col("_key").alias(key), *zero).write.mode("overwrite").parquet(f"{output}/marks/attempt={n}")
    return keys.select(F.col("_key").alias(key))
