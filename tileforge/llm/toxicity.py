"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every labelled training text counts towards the ratios (a hashed table of document counts by class, summed by Spark). The
n-grams that depart most from independence of the label become features; a feature's value is its log-count ratio where
the n-gram occurs in the text, else 0. A logistic model on top is fitted to a bounded sample of the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, unit_hash
from .exact import rows_of

SIZES = (3, 4, 5, 6)
BITS = 18
FEATURES = 2000
#: Expected labelled rows at most that the logistic model is fitted to; the ratios are counted over all of them.
SAMPLE_ROWS = 20_000
LEAST_DOCUMENTS = 3
_FACTOR, _LAST = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_CHUNK = 1 << 21


def grams(b: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character."""
    if len(b) < n:
        return np.empty(0, np.uint32)
    h = np.full(len(b) - n + 1, np.uint32(n))
    for k in range(n):
        h *= _FACTOR
        h ^= b[k : len(b) - n + 1 + k]
    h ^= h >> np.uint32(15)
    h *= _LAST
    return h >> np.uint32(32 - BITS)


def prepared(text: str | None) -> np.ndarray:
    """The code points of the whole text in lower case."""
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(data: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text."""
    seen = np.zeros(1 << BITS, bool)
    for n in SIZES:
        seen[grams(data, n)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """``slot`` is each bucket's feature number or -1; ``weight`` already holds the ratio."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) pairs of the features that occur, each once. Texts are gone through in chunks, whole."""
        rows, found = [], []
        for first, part in _chunks([prepared(t) for t in texts]):
            data, ends = np.concatenate(part), np.cumsum([len(p) for p in part])
            for n in SIZES:
                slots = self.slot[grams(data, n)]
                at = np.flatnonzero(slots >= 0)
                owner = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[owner] if len(at) else np.zeros(0, bool)
                rows.append(first + owner[inside])
                found.append(slots[at[inside]])
        pairs = np.unique(np.concatenate(rows).astype(np.int64) * len(self.weight) + np.concatenate(found)) if rows else np.empty(0, np.int64)
        return pairs // max(1, len(self.weight)), pairs % max(1, len(self.weight))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows, found = self.features(texts)
        z = self.bias + np.bincount(rows, self.weight[found], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _chunks(parts: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    start, size = 0, 0
    for k, p in enumerate(parts):
        size += len(p)
        if size >= _CHUNK:
            yield start, parts[start : k + 1]
            start, size = k + 1, 0
    if start < len(parts):
        yield start, parts[start:]


def fit(rows: DataFrame, features: int = FEATURES, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from ``rows`` (key, text, label). Without rows of both labels it gives every text the same low score.

    Labels other than 0 and 1 do not count; null texts are empty; rows alike count as often as they come.
    """
    rows = rows.filter(F.col("label").isin(0, 1)).withColumn("label", F.col("label").cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        totals = np.zeros(2, np.int64)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y, buckets(prepared(t))] += 1
                totals[y] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0, at], totals[0])), pa.array(np.append(n[1, at], totals[1]))], ["bucket", "n0", "n1"])

    table_ = rows.select("text", "label").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    totals = table_[table_["bucket"] < 0][["n0", "n1"]].sum().to_numpy(np.float64)
    table_ = table_[(table_["bucket"] >= 0) & (table_["n0"] + table_["n1"] >= LEAST_DOCUMENTS)].sort_values("bucket")
    slot, bias = np.full(1 << BITS, -1, np.int32), float(np.log((totals[1] + 0.5) / (totals[0] + 1.0)))
    if not totals.all():
        return Model(slot, np.zeros(1), min(bias, -1.0))
    n0, n1 = table_["n0"].to_numpy(np.float64), table_["n1"].to_numpy(np.float64)
    share = totals[1] / totals.sum()
    surprise = np.abs(n1 - (n0 + n1) * share) / np.sqrt((n0 + n1) * share * (1 - share))
    top = np.sort(np.argsort(-surprise, kind="stable")[:features])
    ratio = np.log((n1[top] + 1) / (totals[1] + 2)) - np.log((n0[top] + 1) / (totals[0] + 2))
    slot[table_["bucket"].to_numpy()[top]] = np.arange(len(top))
    model = Model(slot, ratio, bias)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, f = model.features(b.column(0).to_pylist())
            lists = np.split(f.astype(np.int32), np.cumsum(np.bincount(r, minlength=b.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), b.column(1)], ["features", "label"])

    # by a hash of the key, so that no task sorts texts; the expected number of rows is the bound
    chosen = rows.filter(unit_hash(F.lit("toxic"), "key") < min(1.0, sample_rows / totals.sum()))
    sample = chosen.select("text", "label").mapInArrow(active, "features array<int>, label int").toPandas()
    return logistic(model, [np.asarray(x, np.int64) for x in sample["features"]], sample["label"].to_numpy(np.float64))


def logistic(model: Model, lists: list[np.ndarray], y: np.ndarray, penalty: float = 0.1, rounds: int = 1000) -> Model:
    """Weights for the scaled features by gradient descent with momentum and an L2 penalty, from 0 weights."""
    ratio, n = model.weight, len(y)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    col = np.concatenate(lists) if lists else np.empty(0, np.int64)
    value = ratio[col]
    w, b, vw, vb = np.zeros(len(ratio)), model.bias, np.zeros(len(ratio)), 0.0
    norm = np.bincount(row, value * value, minlength=n)
    rate = 1.0 / (0.25 * (np.mean(norm) + 1) + penalty / n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, value * w[col], minlength=n), -30, 30)))
        gap = p - y
        vw = 0.9 * vw - rate * (np.bincount(col, value * gap[row], minlength=len(w)) + penalty * w) / n
        vb = 0.9 * vb - rate * gap.mean()
        w, b = w + vw, b + vb
    return Model(model.slot, w * ratio, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, 0 to 1; null texts are empty. A column named ``out`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.slot, model.weight, model.bias))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(Model(*shared.value).scores(texts.tolist()))

    return docs.withColumn(out, scored(text))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learnt from labelled ones whose checksum is not divisible by 5.

    Of several label rows of a document the highest of 0 and 1 counts. Empty texts get the score of the model's bias. Rows alike
    in doc_id and text have equal scores; a null doc_id is checked as an empty text and never learnt from.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id") & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rows = rows_of(docs, "doc_id", durable(labels.filter(F.col("doc_id").isNotNull()))).select(F.col("doc_id").alias("key"), "text", "label")
    scored = score(docs, fit(rows)).withColumn("held_out", held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
