"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts mean it, for Java's and DuckDB's regular expressions, and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"

#: A table of at most so many bytes may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

#: A key that meets more rows than this is split in a join; at most so many keys are.
KEY_ROWS, HOT_KEYS = 500, 20_000

#: Rows that one bucket of a running sum aims at; a bucket of so many times that is overfull; buckets that one task may order.
BUCKET_ROWS, FULL_BUCKETS, LEVEL = 1_000, 8, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset and all run on one machine (tests) a temporary folder is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="spark-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read back: its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back.

    For loops: unlike a checkpoint, a table does not take along what the optimizer knew of the plan that made it, which
    grows from round to round until planning takes longer than the work.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values take at most ``most`` bytes, else as it is (joined by a shuffle).

    ``df`` should be cheap to read twice: a stored table, or the result of ``durable``.
    """
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    size = F.lit(16 * len(df.columns))
    for w in wide:
        size = size + w
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def hot_join(rows: DataFrame, facts: DataFrame, on: str, count: str, spread: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``facts`` (one row for each key) where some keys meet very many rows.

    ``count`` of ``facts`` is the number of rows that a key meets, ``total`` the sum of these. Keys above a share of the
    total are so few that their names can be broadcast; their rows are dealt over several tasks by the columns of
    ``spread``, and their facts are copied to each.
    """
    most = max(KEY_ROWS, total // HOT_KEYS)
    parts = F.ceil(F.col(count) / most).cast("int")
    hot = facts.filter(F.col(count) > most).select(on, parts.alias("_parts"))
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int"))
    right = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right, [on, "_salt"]).drop("_salt", "_parts")


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns renamed that begin with an underscore, as those of operators do; their new names; what undoes it."""
    names = {c: f"caller{k}{c}" for k, c in enumerate(docs.columns) if c.startswith("_")}
    return docs.withColumnsRenamed(names), names, lambda out: out.withColumnsRenamed({v: c for c, v in names.items()})


def text_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with at most ``most`` bytes of text each (a longer text is alone)."""
    texts = batch.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def unit_hash(*parts: Column | str, digits: int = 12) -> Column:
    """A uniform number in (0, 1) from md5 over the parts, joined with colons; null parts read ``~``.

    md5 rather than a faster hash so that any SQL engine can repeat it.
    """
    joined = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("double") + 0.5) / float(16**digits)


def buckets_for(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // per_bucket))


def bucket_of(place: Column, buckets: int) -> Column:
    """The bucket of a place in [0, 1); it keeps the order of places."""
    return F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("long")


def sums_before(sums: DataFrame, group: list[str], bucket: str, value: str, buckets: int, out: str) -> DataFrame:
    """``sums`` (one row for each group and bucket 0 .. buckets-1 that occurs) with ``out``: the values of the group's earlier buckets.

    Of a group with very many buckets stretches of buckets are added up first, so that no task orders more than ``LEVEL`` of them.
    """
    order = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda total: F.coalesce(total, F.lit(0))
    if buckets <= LEVEL:
        return sums.withColumn(out, zero(F.sum(value).over(order.partitionBy(*group))))
    step, stretch, inner, outer = -(-buckets // math.isqrt(buckets)), bucket + "_stretch", out + "_inner", out + "_outer"
    staged = sums.withColumn(stretch, F.floor(F.col(bucket) / step)).withColumn(inner, zero(F.sum(value).over(order.partitionBy(*group, stretch))))
    stretches = sums.groupBy(*group, F.floor(F.col(bucket) / step).alias(stretch)).agg(F.sum(value).alias("_all"))
    earlier = sums_before(stretches, group, stretch, "_all", -(-buckets // step), outer).drop("_all")
    return staged.join(earlier, [*group, stretch]).withColumn(out, F.col(outer) + F.col(inner)).drop(stretch, inner, outer)


def running_sum(df: DataFrame, group: str, place: str, order: list[str], value: Column, buckets: int, out: str, more: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before, in the order (place, *order).

    No group meets in one task: rows are dealt by (group, bucket of the place), the buckets' sums are added up level by
    level, and only rows of one bucket are ordered together. ``place`` is in [0, 1) and a hash, so a bucket is overfull only
    where very many rows are alike in place and order; these are numbered by their part of ``df``, which has to be a stored
    table, and then within it. ``more`` has one row per group; its columns are added by way of the buckets' table, so the
    join stays on the same keys.
    """
    keyed = df.withColumns({"_bucket": bucket_of(F.col(place), buckets), "_value": value.cast("long"), "_id": F.monotonically_increasing_id()})
    sums = durable(keyed.groupBy(group, "_bucket").agg(F.sum("_value").alias("_sum"), F.count(F.lit(1)).alias("_rows")))
    placed = sums_before(sums.select(group, "_bucket", "_sum"), [group], "_bucket", "_sum", buckets, "_offset").drop("_sum")
    if more is not None:
        placed = placed.join(more, group)
    full = sums.filter(F.col("_rows") > FULL_BUCKETS * BUCKET_ROWS).select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"))
    own, crowd = F.lit(True), not full.isEmpty()
    if crowd:
        # at most rows / (FULL_BUCKETS x BUCKET_ROWS) names
        near = small(durable(full))
        keyed = keyed.join(near, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
        own = F.col("_b").isNull()
    ordinary = keyed.filter(own)
    within = Window.partitionBy(group, "_bucket").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordinary.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(placed, [group, "_bucket"])
    if crowd:
        alike = F.struct(place, *order)
        crowded = keyed.filter(~own).withColumns({"_alike": alike, "_part": F.shiftright("_id", 33)})
        kinds = durable(crowded.groupBy(group, "_bucket", "_alike", "_part").agg(F.sum("_value").alias("_n")))
        each = Window.partitionBy(group, "_bucket").orderBy("_alike").rowsBetween(Window.unboundedPreceding, -1)
        whole = kinds.groupBy(group, "_bucket", "_alike").agg(F.sum("_n").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(each), F.lit(0))).drop("_n")
        parts = Window.partitionBy(group, "_bucket", "_alike").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        kinds = kinds.withColumn("_earlier", F.coalesce(F.sum("_n").over(parts), F.lit(0))).drop("_n").join(whole, [group, "_bucket", "_alike"]).join(placed, [group, "_bucket"])
        inner = Window.partitionBy(group, "_bucket", "_alike", "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        crowded = crowded.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0))).join(kinds, [group, "_bucket", "_alike", "_part"])
        crowded = crowded.withColumn("_within", F.col("_first") + F.col("_earlier") + F.col("_inner"))
        ranked = ranked.unionByName(crowded.select(ranked.columns)).drop("_g", "_b")
    return ranked.withColumn(out, F.col("_offset") + F.col("_within")).drop("_bucket", "_value", "_id", "_offset", "_within")
