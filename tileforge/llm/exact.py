"""Exact deduplication by two Bloom filter passes.

The first pass looks at hashes only: each task drops the repeats that it sees itself, the rest is dealt by hash, and a
Bloom filter per part tells which hashes possibly come a second time. The second pass tests every row against a Bloom
filter of those hashes: rows that it rules out are unique and pass straight through; only the others are shuffled and
compared. False positives of either filter cost a little work and never change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, durable, hot_join, small, table

#: Bits for each key, probes, keys of one part of the first pass, most bits of one filter of the second (32 MB), most filters.
BITS_PER_KEY, PROBES, KEYS_PER_PART, MOST_BITS, MOST_PARTS = 16, 4, 1_000_000, 1 << 28, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


def probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions for each key; ``bits`` is a power of two."""
    h = keys.view(np.uint64)
    step = ((h * _MIX) >> np.uint64(17)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)])


def power_of_two(least: int) -> int:
    return 1 << max(10, int(least - 1).bit_length())


def repeated_keys(keys: DataFrame, rows: int) -> DataFrame:
    """Of the long column ``key`` the values that possibly occur in two rows or more: all that do, and few others."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n > 1)], ["key", "many"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = power_of_two(BITS_PER_KEY * KEYS_PER_PART)
        seen = np.zeros(bits // 8, np.uint8)
        for b in batches:
            k, many = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            k, first, n = np.unique(k, return_index=True, return_counts=True)
            at = probes(k, bits)
            before = ((seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
            # many of any equal row in this batch counts; equal rows in one batch already make n > 1
            out = k[before | (n > 1) | many[first]]
            np.bitwise_or.at(seen, (at >> np.uint64(3)).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(out)], ["key"])

    parts = max(1, -(-rows // KEYS_PER_PART))
    dealt = keys.mapInArrow(thin, "key long, many boolean").repartition(parts, "key")
    return dealt.mapInArrow(second, "key long").distinct()


def bloom_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the distinct long column ``key``: 16 bits for each, ``MOST_BITS`` at most.

    Its words are put together on the executors; the driver gets the filter, whose size is bounded, never the keys.
    """
    bits = min(power_of_two(BITS_PER_KEY * max(1, keys.count())), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(probes(b.column(0).to_numpy(zero_copy_only=False), bits).ravel())
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(5)).astype(np.int64)), pa.array(np.int64(1) << (at & np.uint64(31)).astype(np.int64))], ["word", "bit"])

    words = keys.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    for part in words.to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy().astype(np.uint32)
    return out


def with_maybe(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: whether the long ``column`` may be among the distinct longs ``key`` of ``keys`` (both stored tables).

    Keys beyond one filter's size are split by hash, each part with a filter of its own that tests the rows of that part: as
    many readings of ``rows`` as parts, ``MOST_PARTS`` at most. Only beyond that do filters let more rows pass than they need.
    """
    parts = min(MOST_PARTS, max(1, -(-power_of_two(BITS_PER_KEY * keys.count()) // MOST_BITS)))
    out = None
    for k in range(parts):
        own = lambda c: F.pmod(F.hash(c), F.lit(parts)) == k
        mine, wanted = (rows, keys) if parts == 1 else (rows.filter(own(column)), keys.filter(own("key")))
        tested = mine.withColumn("_maybe", possibly_in(rows.sparkSession, bloom_of(wanted))(column))
        out = tested if out is None else out.unionByName(tested)
    return out


def held(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys the filter lets pass."""
    at = probes(keys, 32 * len(bloom))
    return ((bloom[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1).all(axis=0)


def possibly_in(spark: SparkSession, bloom: np.ndarray) -> Column:
    """A function that tests a long column against the filter."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(held(shared.value, keys.to_numpy(np.int64)))

    return test


def key_hash(key: str) -> Column:
    return F.xxhash64(key)


def possibly_of(docs: DataFrame, key: str, keys: DataFrame) -> Column:
    """Whether the row's key may be among ``keys`` (a stored table with that one column): true for all that are, and few others."""
    return possibly_in(docs.sparkSession, bloom_of(keys.select(key_hash(keys.columns[0]).alias("key"))))(key_hash(key))


def rows_of(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` joined with those of ``keys`` of the same key (never null, once each).

    A large ``keys`` is shuffled, and with it only those rows that a Bloom filter of it lets pass.
    """
    near = small(keys)
    if near is not keys:
        return docs.join(near, key)
    return docs.filter(possibly_of(docs, key, keys.select(key))).join(keys, key)


def rows_without(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in the one column of ``keys``; rows that a Bloom filter of it rules out are not moved."""
    near, name = small(keys), keys.columns[0]
    if near is not keys:
        return docs.join(near, F.col(key) == F.col(name), "left_anti")
    maybe = possibly_of(docs, key, keys)
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(keys, F.col(key) == F.col(name), "left_anti"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row.

    Of equal texts the row with the most code points stays, then the one with the smallest key, null keys last; of rows
    alike in both, one. Keys and checksums only are moved, and of these only the rows of possible copies; the rows of a
    large group are dealt over several tasks. Texts of any length are hashed whole; columns other than key and text play no part.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(key, F.length(t).alias("_chars"), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("text_sha256"))
    facts = durable(facts.withColumn("_key", F.xxhash64("text_sha256")).withColumn("_row", F.monotonically_increasing_id()))
    rows = facts.count()
    marked = with_maybe(facts, "_key", durable(repeated_keys(facts.select(F.col("_key").alias("key")), rows)))
    alone = marked.filter(~F.col("_maybe")).select(key, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.filter("_maybe")
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col(key).isNull().alias("u"), F.col(key).alias("k"), F.col("_row").alias("r")))
    met = maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best"))
    rest = hot_join(maybe, met, "text_sha256", "group_size", ["_row"], rows).select(key, F.col("_best.k").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.r")).alias("kept"), "text_sha256")
    return alone.unionByName(rest)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as in ``groups``. Rows that have no copy are not moved.

    Columns stay as they came, whatever their names; null and empty texts are one group. Copies are compared where they are
    first, so that a large group sends one row from each task.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(normalised(F.col(text))).alias("_key"))
    keys = row.select(F.col("_key").alias("key"))
    test = possibly_in(docs.sparkSession, bloom_of(durable(repeated_keys(keys, docs.count()))))
    marked = row.withColumn("_maybe", test("_key"))
    order = F.struct(-F.length(F.coalesce(F.col(f"_row.{text}"), F.lit(""))), F.col(f"_row.{key}").isNull(), F.col(f"_row.{key}"))
    met = marked.filter("_maybe").groupBy(F.sha2(normalised(F.col(f"_row.{text}")).cast("binary"), 256).alias("_sha")).agg(F.min_by("_row", order).alias("_row"))
    return marked.filter(~F.col("_maybe")).select("_row.*").unionByName(met.select("_row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents, dropped ones too."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT *, row_number() OVER g AS place, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, r)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
