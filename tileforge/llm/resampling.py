"""Importance resampling towards a target distribution, over hashed n-grams of words.

Texts are taken apart by Arrow kernels: lower case, a split at everything that is no word, one flat list of words with its
dictionary. An n-gram is a pair of its first n-1 words' code and the next word's index, so that a checksum is made once for
each distinct pair of a slice. Two readings of the texts: one counts buckets, one adds up gains; the texts never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, text_slices
from .exact import rows_of

#: What stands between words, after A-Z are lowered.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bytes of text in one slice.
SLICE = 8 << 20


def word_indices(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, each word's index among them, and each word's row. Null texts have no words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BREAKS)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(real))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)


def gram_buckets(texts: pa.Array, grams: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words in each row, for n = 1 .. ``grams`` the rows and buckets of all runs of n words)."""
    dictionary, index, row = word_indices(texts)
    words = [w.as_py().encode() for w in dictionary]
    code, at = index, row
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    out = [(row, (crc % buckets)[code] if len(words) else code)]
    for n in range(2, grams + 1):
        # the run of n-1 words that starts here, and the word that follows it in the same row
        held = at[: max(0, len(index) - n + 1)] == row[n - 1 :]
        pairs = code[: len(held)] * len(words) + index[n - 1 :]
        both, place = np.unique(pairs[held], return_inverse=True)
        crc = np.array([zlib.crc32(b" " + words[k % len(words)], int(crc[k // len(words)])) for k in both.tolist()], np.uint32)
        code = np.zeros(len(held), np.int64)
        code[held] = place
        at = np.where(held, at[: len(held)], -1)
        out.append((at[held], (crc % buckets)[place] if len(both) else place))
    return np.bincount(row, minlength=len(texts)), out


def bucket_counts(texts: DataFrame, text: str, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the n-grams of all rows in each bucket. A task hands on one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in text_slices(b, 0, SLICE):
                for _, found in gram_buckets(part.column(0), grams, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket ``floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets))))``: t of T n-grams of the target, s of S of the documents.

    The driver gets ``buckets`` whole numbers, however large the tables are.
    """
    spark = docs.sparkSession
    raw = bucket_counts(docs, text, grams, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = raw.unionByName(bucket_counts(target, target_text, grams, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = durable(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(F.broadcast(both), "bucket", "left").fillna(0, ["s", "t"])
    above = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    found = every.select("bucket", F.floor(1000.0 * F.log(above / below)).cast("long").alias("gain")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["gain"].to_numpy(np.int64)
    return out


def importance_weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", grams: int = GRAMS) -> DataFrame:
    """(key, n_words, n_features, weight) of every row: the weight is the floored mean of the gains of its n-grams, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = pa.array(shared.value)
        for b in batches:
            for part in text_slices(b, 1, SLICE):
                words, runs = gram_buckets(part.column(1), grams, len(gain))
                n, sums = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for rows, found in runs:
                    if len(rows):
                        # rows stand in order, so that each row's gains are one segment
                        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                        sums[rows[first]] += np.add.reduceat(gain.take(pa.array(found)).to_numpy(zero_copy_only=False), first)
                        n += np.bincount(rows, minlength=len(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(n), pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0))], ["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(weigh, f"key {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: str = SEED) -> Column:
    """``floor(-1000 ln(-ln(u)))`` with u from the first 32 bits of the sha256 of ``seed:key``; a null key reads ``~``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("~"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``, for a sample of ``percent`` of those with ``least_words`` words.

    A score is the row's weight towards ``target`` plus Gumbel noise that its key fixes; the highest scores are drawn (ties to
    the smaller key, null keys last) and numbered from 1; ``rank`` is null elsewhere. Scores are whole numbers of a narrow
    range, so a count for each score finds the lowest one that is drawn; only rows from there on are sorted, by ranges of
    (score, key), and numbered by the ranges' counts. No row count is bounded and no task sees more than a range.

    Null and empty texts, and those without words, have no features, weight 0 and no rank. Rows alike in key and text have
    the same score and ranks of their own. Texts of any length are read whole; columns other than key and text play no part.
    An empty table gives an empty result; an empty target gives gains by the documents' counts alone.
    """
    gains = bucket_gains(docs, target, text, target_text, grams, buckets)
    scored = durable(importance_weights(docs, gains, key, text, grams).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)))
    enough = F.col("n_words") >= least_words
    by_score = durable(scored.filter(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    wanted = (by_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))
    # one row for each score that occurs: as many as the range of gains and noise has whole numbers
    lowest = by_score.withColumn("upto", upto).filter(F.col("upto") >= wanted).agg(F.max("score")).first()[0]
    shown = [F.col("key").alias(key), "n_features", "weight", "score"]
    if lowest is None or not wanted:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    inside = enough & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_last("key")]
    sorted_rows = scored.filter(inside).repartitionByRange(*order).sortWithinPartitions(*order)
    # the row's number in its range, and the range's number
    placed = durable(sorted_rows.withColumn("_id", F.monotonically_increasing_id())).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_before"))
    ranked = placed.join(F.broadcast(parts), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1)
    ranked = ranked.select(*shown, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return scored.filter(~inside).select(*shown, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def drawn_rows(docs: DataFrame, target: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` that ``draw`` draws, with their columns as they came; keys must be unique and not null."""
    keys = durable(draw(docs, target, key=key, **settings).filter("rank IS NOT NULL").select(F.col(key).alias("_drawn")))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_drawn"))
    return rows_of(whole, "_drawn", keys).select("_row.*")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents towards the benchmark's texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return draw(docs, table(spark, sf_dir, "benchmark").select("text"))


OP11_SQL = """
WITH steps AS (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) t(i)
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps),
texts AS (
    SELECT row_number() OVER () AS r, doc_id, text, true AS raw FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark
), words AS (
    SELECT r, raw, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
    FROM texts
), buckets AS (
    SELECT w, xor(4294967295, list_reduce(
        list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda b: ('0x' || b)::BIGINT),
        lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT)) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM words), crc_table
), counts AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS total_s, coalesce(sum(t), 0)::DOUBLE AS total_t FROM counts),
gains AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * (total_s + 10000)) / ((s + 1)::DOUBLE * (total_t + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE raw GROUP BY r),
scored AS (
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           (coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '~')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (r) WHERE texts.raw
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM ranked
"""
