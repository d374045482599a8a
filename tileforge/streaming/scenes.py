"""Incremental processing: new tiles are picked up as they arrive, each once; metrics run on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def process_new(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Appends what ``stream`` brings to ``output`` and stops when it has caught up; a later call goes on from there."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_confusion(stream: DataFrame, true: str, pred: str, nodata: int, *keys: str) -> DataFrame:
    """Confusion counts of all blocks so far. The state has one row for each key and class pair, so no watermark is needed."""
    valid = stream.filter(F.col(true).isNotNull() & F.col(pred).isNotNull() & (F.col(true) != nodata) & (F.col(pred) != nodata))
    return valid.groupBy(*keys, F.col(true).cast("int").alias("true_class"), F.col(pred).cast("int").alias("pred_class")).agg(F.count(F.lit(1)).alias("n"))


def latest(counts: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest complete result under ``output``; a batch that is run again writes the same files."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(output)

    return counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scene_confusion(stream: DataFrame, classes: int, nodata: int) -> DataFrame:
    """(scene_id, true_class, pred_class, n) of each scene, zero cells too, once: when the last of its tiles has come.

    ``stream`` has scene_id, tile_row, tile_col, n_tiles (of the scene), and ``labels`` and ``preds``, arrays of a tile's pixels. Tiles
    come in any order and over any number of triggers; one that comes again does not count again. A scene's state is its
    counts and the places of its tiles; with the report both are let go, and one mark stays, by which late repeats are known.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, counts, seen = state.get if state.exists else (False, [0] * classes**2, [])
        counts, seen, expected = np.array(counts, np.int64), set(seen), None
        for f in frames:
            if done:
                continue
            for row, col, n, labels, preds in zip(f["tile_row"], f["tile_col"], f["n_tiles"], f["labels"], f["preds"]):
                place, expected = int(row) << 32 | int(col), int(n)
                if place not in seen:
                    seen.add(place)
                    t, p = np.asarray(labels, np.int64), np.asarray(preds, np.int64)
                    held = (t != nodata) & (p != nodata)
                    counts += np.bincount(t[held] * classes + p[held], minlength=classes**2)
        if done or (expected is not None and len(seen) >= expected):
            if not done:
                cell = np.arange(classes**2)
                yield pd.DataFrame({"scene_id": key[0], "true_class": cell // classes, "pred_class": cell % classes, "n": counts})
            state.update((True, [], []))
        else:
            state.update((False, counts.tolist(), sorted(seen)))

    schema = "scene_id string, true_class int, pred_class int, n long"
    keyed = stream.select("scene_id", "tile_row", "tile_col", "n_tiles", "labels", "preds").groupBy("scene_id")
    return keyed.applyInPandasWithState(update, schema, "done boolean, counts array<long>, seen array<long>", "append", GroupStateTimeout.NoTimeout)
