"""Sharding: rendezvous hashing of stable record keys over weighted shards (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, durable, running_sum, table, unit_hash

SHARDS = 40


def draw(key: Column, shard: Column | int, weight: Column | float) -> Column:
    """The shard's draw for the key: ``-ln(u) / weight`` with u from the hash of (key, shard)."""
    shard = F.lit(shard) if isinstance(shard, int) else shard
    return -F.log(unit_hash(key, shard)) / weight


def winner(key: Column, weights: list[float]) -> Column:
    """struct<draw, shard> of the shard 0 .. len(weights)-1 that wins the key: the least draw.

    A shard's draw depends on nothing but the key, its own number and its own weight, so a further shard takes rows only
    into itself, and a shard of weight 0 gets nothing. A null key is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, and one must be positive")
    shards = F.array(*[F.struct(F.lit(k).alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights) if w > 0])
    return F.array_min(F.transform(shards, lambda s: F.struct(draw(key, s["shard"], s["weight"]).alias("draw"), s["shard"].alias("shard"))))


def shard_of(key: Column, weights: list[float]) -> Column:
    return winner(key, weights)["shard"].cast("int")


def grown(key: Column, weights: list[float], extra: float = 1.0) -> Column:
    """The shard after one more of weight ``extra`` is added."""
    return grown_from(winner(key, weights), key, len(weights), extra)


def grown_from(won: Column, key: Column, number: int, extra: float = 1.0) -> Column:
    """The same from the winner among ``number`` shards: only the new shard's draw is made."""
    return F.when(draw(key, number, extra) < won["draw"], number).otherwise(won["shard"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: list[float], shard: str = "shard") -> DataFrame:
    """``df`` with its shard; a narrow projection, nothing moves. Columns that clash with ``shard`` are replaced."""
    return df.withColumn(shard, shard_of(F.col(key), weights))


def write_shards(df: DataFrame, key: str, weights: list[float], path: str, shard: str = "shard") -> None:
    """Writes a folder for each shard. Rows are dealt by (shard, part), so that a heavy shard takes many tasks."""
    parts = buckets_for(df.count()) + len(weights)
    dealt = assign_shards(df, key, weights, shard).repartition(parts, F.col(shard), F.floor(unit_hash(F.lit("part"), key) * max(1, parts // len(weights))))
    dealt.write.mode("overwrite").partitionBy(shard).parquet(path)


def with_slots(df: DataFrame, shard: str, key: str, ties: list[str], rows: int, slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in the order of a hash of the key and ``ties``, then of these themselves.

    Rows alike in all of these are alike in the result, so their order does not matter. As the hash is not of the key alone,
    rows that share one are dealt over all buckets.
    """
    placed = df.withColumn("_place", unit_hash(F.lit("slot"), key, *ties))
    return running_sum(placed, shard, "_place", [key, *ties], F.lit(1), buckets_for(rows), slot).drop("_place")


def op1_shard_documents(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """All documents over equal shards 0 .. ``shards``-1 by law ``key``.

    Null and empty texts have size 16 and checksum 0; repeated rows share a shard and get slots of their own; a null
    doc_id is hashed as ``~``. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = [1.0] * shards
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # a struct that is exploded: the draws are made once, whatever is asked of the winner
    won = sized.withColumn("_won", F.explode(F.array(winner(F.col("doc_id"), weights))))
    placed = durable(won.withColumns({"shard": F.col("_won.shard").cast("int"), "grown_shard": grown_from(F.col("_won"), F.col("doc_id"), shards)}).drop("_won"))
    slotted = with_slots(placed, "shard", "doc_id", ["size", "text_crc32"], placed.count())
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


OP1_SQL = """
WITH steps AS (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) t(i)
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps),
d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           octet_length(encode(coalesce(text, ''))) + 16 AS size, coalesce(doc_id::VARCHAR, '~') AS k
    FROM documents
), crc AS (
    SELECT r, xor(4294967295, list_reduce(
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT),
        lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT)) AS text_crc32
    FROM d, crc_table
), draws AS (
    SELECT r, s, -ln((('0x' || substr(md5(k || ':' || s), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) AS draw
    FROM d, range(41) t(s)
), won AS (
    SELECT r, (arg_min(s, draw) FILTER (s < 40))::INTEGER AS shard, arg_min(s, draw)::INTEGER AS grown_shard FROM draws GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || k || ':' || size || ':' || text_crc32), 1, 12))::BIGINT, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM d JOIN crc USING (r) JOIN won USING (r)
"""
