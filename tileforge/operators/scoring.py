"""Scoring tiles with a user's vectorised model and stitching the outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .windows import arrow_schema, as_batch, put_together, slices


#: Types of outputs by name: in the table, and in NumPy. An unsigned byte has no type of its own in Spark and is held in 16 bits.
OUTPUTS = {"double": ("array<double>", "float64"), "float": ("array<float>", "float32"), "int": ("array<int>", "int32"), "short": ("array<smallint>", "int16"), "byte": ("array<smallint>", "uint8")}


def score_tiles(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray], patch: tuple[int, int] | None = None, nodata: float | None = None, transform: Callable[[np.ndarray], np.ndarray] | None = None, dtype: str = "double") -> DataFrame:
    """(scene_id, tile_row, tile_col, min_x, min_y, out_h, out_w, n_out, scores): ``model`` over every tile's data.

    ``model`` takes [n, h, w, bands] and gives [n, h', w', classes]; it travels with the task and is called once per tile, or per
    batch of patches. The output is centred on the tile: min_x and min_y are moved by half of what the model crops. ``tiles``
    has ``data``, or the ``strips`` of ``windows.overlapping_tiles``; a tile's owner box (v_min_x ..) goes along.

    Outputs whose pixel of the first band is ``nodata`` become NaN, and with it NULL in the table. ``transform`` then makes an image of its own number of
    bands of each tile's output, and ``dtype`` its own type (``OUTPUTS``; values are cut to whole numbers, NaN is 0 there).
    """
    kind, numpy_kind = OUTPUTS[dtype]
    owner = [c for c in ("v_min_x", "v_min_y", "v_max_x", "v_max_y") if c in tiles.columns]
    body = "strips" if "strips" in tiles.columns else "data"
    fields = ["scene_id", "tile_row", "tile_col", "min_x", "min_y", "out_h", "out_w", "n_out", "scores", *owner]

    schema = f"scene_id string, tile_row int, tile_col int, min_x int, min_y int, out_h int, out_w int, n_out int, scores {kind}" + "".join(f", {c} int" for c in owner)
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in slices(batches):
            rows = []
            for t in f.itertuples(index=False):
                h, w = t.max_y - t.min_y, t.max_x - t.min_x
                image = put_together(h, w, t.n_bands, t.min_x, t.min_y, t.strips) if body == "strips" else kernels.grid(t.data, h, w, t.n_bands)
                out = np.asarray(kernels.run_model(model, image, patch))
                oy, ox = (h - out.shape[0]) // 2, (w - out.shape[1]) // 2
                if nodata is not None:
                    out = np.where((image[oy : oy + out.shape[0], ox : ox + out.shape[1], 0] == nodata)[..., None], np.nan, out)
                out = out if transform is None else np.asarray(transform(out))
                out = (out if numpy_kind.startswith("float") else np.nan_to_num(out, nan=0.0)).astype(numpy_kind)
                out = out.astype("int16") if dtype == "byte" else out
                rows.append((t.scene_id, t.tile_row, t.tile_col, t.min_x + ox, t.min_y + oy, *out.shape, out.reshape(-1), *(getattr(t, c) for c in owner)))
            yield as_batch(pd.DataFrame(rows, columns=fields), shape)

    columns = ["scene_id", "tile_row", "tile_col", "min_x", "min_y", "max_x", "max_y", "n_bands", body, *owner]
    out = tiles.select(*columns).mapInArrow(run, schema)
    return out.withColumn("scores", F.transform("scores", lambda v: F.when(~F.isnan(v), v))) if nodata is not None and numpy_kind.startswith("float") else out


def stitch(scored: DataFrame, valid: DataFrame | None = None, unique: bool = True) -> DataFrame:
    """(scene_id, y, x, probs): output pixels that the tile owns.

    ``valid`` gives each tile's owner box in v_min_x .. v_max_y, unless the tiles have them already. It meets the tiles, and only the rows and columns of a tile
    that it owns are taken out, so pixels never move. Owners are unique where the overlap is even; with an odd one
    (``unique`` False) neighbours own one row of pixels both, and the tile of the lowest index wins.
    """
    y, x = [F.col("min_y"), F.col("min_y") + F.col("out_h")], [F.col("min_x"), F.col("min_x") + F.col("out_w")]
    rows = scored if valid is None else scored.join(valid, ["scene_id", "tile_row", "tile_col"])
    owned = "v_min_x" in rows.columns
    if owned:
        y, x = [F.greatest(y[0], "v_min_y"), F.least(y[1], "v_max_y")], [F.greatest(x[0], "v_min_x"), F.least(x[1], "v_max_x")]
    rows = rows.withColumns({"_y0": y[0].cast("int"), "_y1": y[1].cast("int"), "_x0": x[0].cast("int"), "_x1": x[1].cast("int")}).filter("_y1 > _y0 AND _x1 > _x0")
    rows = rows.withColumn("y", F.explode(F.sequence(F.col("_y0"), F.col("_y1") - 1)))
    line = F.slice("scores", ((F.col("y") - F.col("min_y")) * F.col("out_w") + F.col("_x0") - F.col("min_x")) * F.col("n_out") + 1, (F.col("_x1") - F.col("_x0")) * F.col("n_out"))
    rows = rows.select("scene_id", "tile_row", "tile_col", "y", "_x0", "n_out", line.alias("_line"), F.explode(F.sequence(F.lit(0), F.col("_x1") - F.col("_x0") - 1)).alias("_at"))
    rows = rows.select("scene_id", "tile_row", "tile_col", "y", (F.col("_x0") + F.col("_at")).alias("x"), F.slice("_line", F.col("_at") * F.col("n_out") + 1, F.col("n_out")).alias("probs"))
    if not owned or unique:
        return rows.drop("tile_row", "tile_col")
    return rows.groupBy("scene_id", "y", "x").agg(F.min_by("probs", F.struct("tile_row", "tile_col")).alias("probs"))


def halo_tiles(pixels: DataFrame, tile: int, halo: int, value: str = "value") -> DataFrame:
    """(scene_id, tile_row, tile_col, y, x, value): the pixels of each tile and of a margin around it.

    Only border pixels are copied, to the tiles whose margin holds them; no task sees a whole scene.
    """

    def indices(at: str):
        return F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - halo) / tile)).cast("int"), F.floor((F.col(at) + halo) / tile).cast("int"))

    rows = pixels.withColumn("tile_row", F.explode(indices("y"))).withColumn("tile_col", F.explode(indices("x")))
    return rows.select("scene_id", "tile_row", "tile_col", "y", "x", value)


def apply_to_halo_tiles(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], tile: int, halo: int, value: str = "value") -> DataFrame:
    """(scene_id, y, x, value): a NumPy kernel on the plane of each tile and its margin; the tile's own pixels are kept.

    The plane ends where the raster ends, so a kernel treats the raster's edges as it would in one piece. Missing and NULL cells are
    NaN; results of NaN become NULL.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(f["y"].min()), int(f["x"].min())
        plane = np.full((int(f["y"].max()) - y0 + 1, int(f["x"].max()) - x0 + 1), np.nan)
        plane[f["y"] - y0, f["x"] - x0] = f[value]
        out = kernel(plane)
        own = f[(f["y"] // tile == f["tile_row"]) & (f["x"] // tile == f["tile_col"])]
        return pd.DataFrame({"scene_id": own["scene_id"], "y": own["y"], "x": own["x"], "value": out[own["y"] - y0, own["x"] - x0]})

    rows = halo_tiles(pixels, tile, halo, value).groupBy("scene_id", "tile_row", "tile_col").applyInPandas(run, "scene_id string, y int, x int, value double")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def fill_nodata(pixels: DataFrame, reach: int = 16, tile: int = 256, value: str = "value") -> DataFrame:
    """Gaps from valid pixels within ``reach`` by inverse distance, then one smoothing pass over what was filled."""
    return apply_to_halo_tiles(pixels, lambda p: kernels.fill_gaps(p, reach), tile, reach + 1, value)


def gaussian_blur(pixels: DataFrame, sigma: float = 9.0, tile: int = 256, value: str = "value") -> DataFrame:
    """Edges are reflected; the filter ends at four deviations."""
    return apply_to_halo_tiles(pixels, lambda p: kernels.blur(p, sigma), tile, int(4 * sigma + 0.5), value)


def tile_pair_measure(pairs: DataFrame, measure: Callable[[np.ndarray, np.ndarray], float], side: int, out: str, bands: int = 1) -> DataFrame:
    """``out``: a NumPy measure of the square images of some bands in the array columns ``a`` and ``b`` of each row."""
    shape = (side, side) if bands == 1 else (side, side, bands)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(np.asarray(p, np.float64).reshape(shape), np.asarray(q, np.float64).reshape(shape)) for p, q in zip(a, b)])

    return pairs.withColumn(out, run("a", "b"))


def ms_ssim_loss(pairs: DataFrame, side: int, out: str = "loss", bands: int = 1) -> DataFrame:
    return tile_pair_measure(pairs, lambda a, b: 1 - kernels.ms_ssim(a, b), side, out, bands)


def ms_ssim_mse_loss(pairs: DataFrame, side: int, out: str = "loss", bands: int = 1) -> DataFrame:
    return tile_pair_measure(pairs, kernels.ms_ssim_mse, side, out, bands)


def surface_loss(pairs: DataFrame, side: int, out: str = "loss") -> DataFrame:
    return tile_pair_measure(pairs, kernels.surface_loss, side, out)
