"""Windows over stored tiles: overlapping tiles and tiles inside bounds, cut from blocks and put together without a row for each pixel.

Blocks are tiles side by side (scene_id, tile_row, tile_col, min_x .. max_y, n_bands, data). Which windows a block reaches
follows from its place and the scene's size alone, so a block meets no table of windows: it is cut where it is read, and only
its strips move, once, to the window that they are part of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("min_x", "min_y", "max_x", "max_y")
WANTED = "array<struct<tile_row:int,tile_col:int,min_x:int,min_y:int,max_x:int,max_y:int,v_min_x:int,v_min_y:int,v_max_x:int,v_max_y:int>>"
#: Scenes whose sizes are sent to every task; more are joined by a shuffle.
SENT_SCENES = 500_000
#: Bytes of tiles that are NumPy or Python objects at a time.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Batches as frames of about ``SLICE_BYTES`` each: lists and structs take many times their bytes once they are Python objects."""
    for b in batches:
        step = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step).to_pandas()


def as_batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(frame[f.name]), f.type) for f in schema], schema=schema)


def arrow_schema(text: str) -> pa.Schema:
    """Of columns of plain types and arrays of these, as Spark writes them."""
    plain = {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "float": pa.float32(), "double": pa.float64()}
    kind = lambda t: pa.list_(plain[t[6:-1]]) if t.startswith("array<") else plain[t]
    return pa.schema([(n, kind(t)) for n, t in (f.split() for f in text.split(", "))])


def _axis(low: Column, high: Column, first: Column, last: Column, size: Column, tile: int, overlap: int) -> Column:
    """array<struct<i, start, own0, own1>>: the windows along one axis that meet [low, high).

    Windows start at ``first`` and every tile - overlap after it until ``last`` is covered; one that would stick out of the
    image of ``size`` is moved back to end on its edge. What a window owns is taken before it is moved.
    """
    step, half = tile - overlap, overlap // 2
    n = F.ceil((last - first - overlap) / step).cast("int")
    a = F.greatest(F.lit(0), F.ceil((low - first - tile + 1) / step)).cast("int")
    z = F.least(n - 1, F.floor((high - 1 - first) / step)).cast("int")
    # a window that was moved back is the last one, or all of those that the image's edge moves
    moved = F.greatest(F.lit(0), F.floor((size - tile - first) / step) + 1).cast("int")
    near = F.when(z >= a, F.sequence(a, z)).otherwise(F.array().cast("array<int>"))
    late = F.when(moved <= n - 1, F.sequence(moved, n - 1)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        at = first + i * step
        own0 = at + F.when(i > 0, half).otherwise(0)
        own1 = F.least(at + tile - F.when(i < n - 1, half).otherwise(0), last)
        return F.struct(i.cast("int").alias("i"), F.least(at, size - tile).cast("int").alias("start"), own0.cast("int").alias("own0"), own1.cast("int").alias("own1"))

    every = F.transform(F.array_distinct(F.concat(near, late)), window)
    return F.filter(F.when(n > 0, every), lambda w: (w["start"] >= 0) & (w["start"] < high) & (w["start"] + tile > low))


def windows_of(blocks: DataFrame, scenes: DataFrame, tile: tuple[int, int], overlap: tuple[int, int] = (0, 0), bounds: tuple[int, int, int, int] | None = None, block: tuple[int, int] | None = None) -> DataFrame:
    """``blocks`` with ``wanted``: the windows of ``tile`` (x, y) that each block is part of; blocks of no window fall out.

    ``scenes`` has scene_id, width and height. With ``bounds`` (min_x, min_y, max_x, max_y) windows cover these only, but may
    read what lies beyond; given the size of a ``block``, blocks too far away are left out by their row and column, which
    prunes folders of tiles that were written by row.
    """
    if tile[0] <= overlap[0] or tile[1] <= overlap[1]:
        raise ValueError("the overlap must be smaller than the tile")
    if bounds is not None and block is not None:
        for name, k, low, high in (("tile_col", 0, bounds[0], bounds[2]), ("tile_row", 1, bounds[1], bounds[3])):
            blocks = blocks.filter(F.col(name).between((low - tile[k] + 1) // block[k], (high + tile[k] - 2) // block[k]))
    sizes = scenes.select("scene_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    rows = blocks.join(F.broadcast(sizes) if sizes.count() <= SENT_SCENES else sizes, "scene_id")
    x0, y0, x1, y1 = [F.lit(v) for v in bounds] if bounds is not None else [F.lit(0), F.lit(0), F.col("_w"), F.col("_h")]
    xs = _axis(F.col("min_x"), F.col("max_x"), x0, x1, F.col("_w"), tile[0], overlap[0])
    ys = _axis(F.col("min_y"), F.col("max_y"), y0, y1, F.col("_h"), tile[1], overlap[1])
    both = F.flatten(F.transform(F.col("_ys"), lambda r: F.transform(F.col("_xs"), lambda c: F.struct(
        r["i"].alias("tile_row"), c["i"].alias("tile_col"), c["start"].alias("min_x"), r["start"].alias("min_y"), (c["start"] + tile[0]).alias("max_x"), (r["start"] + tile[1]).alias("max_y"),
        c["own0"].alias("v_min_x"), r["own0"].alias("v_min_y"), c["own1"].alias("v_max_x"), r["own1"].alias("v_max_y")))))
    rows = rows.withColumns({"_xs": xs, "_ys": ys}).withColumn("wanted", both.cast(WANTED))
    return rows.drop("_w", "_h", "_xs", "_ys").filter(F.size("wanted") > 0)


def strips(blocks: DataFrame) -> DataFrame:
    """One row for each block and window of ``wanted``: the window's place and owner box, and the part of the block that it needs."""
    kind = blocks.schema["data"].dataType.simpleString()
    fields = ["scene_id", "tile_row", "tile_col", *SIDES, *[f"v_{s}" for s in SIDES], "n_bands", *[f"s_{s}" for s in SIDES], "data"]
    schema = "scene_id string, " + ", ".join(f"{f} int" for f in fields[1:-1]) + f", data {kind}"

    shape = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in slices(batches):
            out = []
            for scene, x0, y0, x1, y1, bands, data, wanted in zip(*(f[c] for c in ("scene_id", *SIDES, "n_bands", "data", "wanted"))):
                plane = np.asarray(data, np.float64).reshape(y1 - y0, x1 - x0, bands)
                for w in wanted:
                    a, b = max(x0, w["min_x"]), max(y0, w["min_y"])
                    c, d = min(x1, w["max_x"]), min(y1, w["max_y"])
                    part = np.ascontiguousarray(plane[b - y0 : d - y0, a - x0 : c - x0]).reshape(-1)
                    out.append((scene, *(w[n] for n in ("tile_row", "tile_col", *SIDES, *[f"v_{s}" for s in SIDES])), bands, a, b, c, d, part))
            yield as_batch(pd.DataFrame(out, columns=fields), shape)

    return blocks.select(F.col("scene_id").cast("string"), *SIDES, "n_bands", "data", "wanted").mapInArrow(cut, schema)


def gathered(parts: DataFrame) -> DataFrame:
    """One row for each window with its ``strips`` together: the one shuffle, by window."""
    place = ["scene_id", "tile_row", "tile_col", *SIDES, *[f"v_{s}" for s in SIDES], "n_bands"]
    return parts.groupBy(*place).agg(F.collect_list(F.struct(*[f"s_{s}" for s in SIDES], "data")).alias("strips"))


def put_together(h: int, w: int, bands: int, min_x: int, min_y: int, parts) -> np.ndarray:
    """The window's array; what is NULL or covered by no strip is NaN."""
    out = np.full((h, w, bands), np.nan)
    for p in parts:
        a, b, c, d = p["s_min_x"] - min_x, p["s_min_y"] - min_y, p["s_max_x"] - min_x, p["s_max_y"] - min_y
        out[b:d, a:c] = np.asarray(p["data"], np.float64).reshape(d - b, c - a, bands)
    return out


def overlapping_tiles(blocks: DataFrame, scenes: DataFrame, tile: tuple[int, int], overlap: tuple[int, int] = (0, 0), **more) -> DataFrame:
    """The windows of ``windows_of`` with their ``strips``; ``scoring.score_tiles`` puts these together where it scores them."""
    return gathered(strips(windows_of(blocks, scenes, tile, overlap, **more)))


def with_data(windows: DataFrame) -> DataFrame:
    """``overlapping_tiles`` as plain tiles with ``data``, for all that does not score them."""
    fields = ["scene_id", "tile_row", "tile_col", *SIDES, *[f"v_{s}" for s in SIDES], "n_bands"]

    schema = "scene_id string, " + ", ".join(f"{f} int" for f in fields[1:]) + ", data array<double>"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in slices(batches):
            data = [put_together(y1 - y0, x1 - x0, b, x0, y0, parts).reshape(-1) for x0, y0, x1, y1, b, parts in zip(*(f[c] for c in (*SIDES, "n_bands", "strips")))]
            yield as_batch(f[fields].assign(data=data), shape)

    return windows.select(*fields, "strips").mapInArrow(run, schema)
