"""Training samples: chunks, deterministic shuffles, batches and augmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.pixels import uniform


def chunks(tiles: DataFrame, chunk: int, stride: int, output: int) -> DataFrame:
    """(scene_id, chunk_row, chunk_col, image, label): windows of ``chunk`` at a stride and the centre ``output`` of their labels.

    ``tiles`` has height, width, n_bands, data and labels (row-major). Windows lie wholly inside the tile; chunk and output are
    both even or both odd. Tiles are joined with their labels before, so that tiles move and never chunks.
    """
    if (chunk - output) % 2:
        raise ValueError("chunk and output must be both even or both odd")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for scene, h, w, b, data, labels in zip(f["scene_id"], f["height"], f["width"], f["n_bands"], f["data"], f["labels"]):
                for r, c, image, label in kernels.chunks(data, labels, h, w, b, chunk, stride, output):
                    rows.append((scene, r, c, image, label))
            yield pd.DataFrame(rows, columns=["scene_id", "chunk_row", "chunk_col", "image", "label"])

    return tiles.select("scene_id", "height", "width", "n_bands", "data", "labels").mapInPandas(cut, "scene_id string, chunk_row int, chunk_col int, image array<float>, label array<int>")


def pair_samples(images: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    return images.join(labels, key)


def drop_empty(samples: DataFrame, nodata: int, label: str = "label") -> DataFrame:
    """Keeps samples with any label that is not nodata."""
    return samples.filter(F.exists(label, lambda x: x != nodata))


def epoch_offset(seed: int, epoch: int, most: int) -> tuple[Column, Column]:
    """One (dx, dy) in [-most, most] for the epoch."""
    return tuple((F.floor(uniform(seed, F.lit(epoch), F.lit(axis)) * (2 * most + 1)) - most).cast("int") for axis in ("x", "y"))


def moved(pixels: DataFrame, key: str, source_y: Column, source_x: Column, fill: dict | None = None) -> DataFrame:
    """Every pixel with all columns but its place from another place of the scene, so that bands and labels move together.

    Where that place is outside, a column is what ``fill`` says, or the pixel is left out if ``fill`` is None.
    """
    rest = [c for c in pixels.columns if c not in (key, "y", "x")]
    target = pixels.select(key, "y", "x", source_y.cast("int").alias("_sy"), source_x.cast("int").alias("_sx"))
    source = pixels.select(F.col(key), F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.lit(True).alias("_in"), *[F.col(c).alias(c) for c in rest])
    rows = target.join(source, [key, "_sy", "_sx"], "inner" if fill is None else "left")
    filled = [c if fill is None else F.when(F.col("_in"), F.col(c)).otherwise(F.lit(fill.get(c, 0))).alias(c) for c in rest]
    return rows.select(key, "y", "x", *filled)


def shifted(pixels: DataFrame, dx: Column, dy: Column, fill: dict | None = None, key: str = "scene_id") -> DataFrame:
    """The raster and its labels seen through a window moved by (dx, dy); outside a column is 0 or what ``fill`` says."""
    return moved(pixels, key, F.col("y") + dy, F.col("x") + dx, fill or {})


def shuffle_key(seed: int, epoch: int, *key: str) -> Column:
    """Orders samples anew in each epoch, images and labels alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(k).cast("string") for k in key]))


#: Samples that are changed at a time.
BATCH = 256
#: Samples that one task orders.
ORDERED = 10_000


def numbered(samples: DataFrame, order: Column, ties: list[str]) -> DataFrame:
    """``position`` from 0 in the order of a uniform hex key: counts by leading digits first, then rows within these.

    There are as many parts as samples ask for, so no task orders more than some ten thousand. The parts' counts are added
    up by their own leading digits, so that table is never one group either.
    """
    rows = samples.withColumn("_order", order)
    digits, total = 1, rows.count()
    while 16**digits * ORDERED < total:
        digits += 1
    rows = rows.withColumns({"_part": F.substring("_order", 1, digits), "_lead": F.substring("_order", 1, max(1, digits // 2))})
    counts = rows.groupBy("_lead", "_part").agg(F.count(F.lit(1)).alias("_n"))
    leads = counts.groupBy("_lead").agg(F.sum("_n").alias("_all"))
    leads = leads.withColumn("_first", F.coalesce(F.sum("_all").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_lead").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("_inner", inner).join(leads, "_lead").select("_part", (F.col("_first") + F.col("_inner")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_order", *ties)) - 1
    return rows.withColumn("_within", within).join(before, "_part").withColumn("position", F.col("_before") + F.col("_within")).drop("_order", "_part", "_lead", "_before", "_within")


def batches(samples: DataFrame, size: int, steps: int | None = None, epochs: int = 1) -> DataFrame:
    """Full batches only: (epoch, batch) for each sample of ``numbered``; at most ``steps`` batches an epoch."""
    total = samples.agg(F.floor(F.count(F.lit(1)) / size).alias("_full"))
    rows = samples.withColumn("batch", F.floor(F.col("position") / size).cast("int")).join(F.broadcast(total), F.col("batch") < F.col("_full")).drop("_full")
    rows = rows if steps is None else rows.filter(F.col("batch") < steps)
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def hold_out(samples: DataFrame, first: int) -> DataFrame:
    """``split``: the first samples are for validation. The unit is the sample, whatever the batch size."""
    return samples.withColumn("split", F.when(F.col("position") < first, "validation").otherwise("train"))


def autoencoder_pairs(samples: DataFrame) -> DataFrame:
    return samples.withColumn("label", F.col("image"))


def flips(pixels: DataFrame, width: int | Column, height: int | Column, probability: float, seed: int, key: str = "scene_id") -> DataFrame:
    """Each scene mirrored left-right and top-down with the probability; all bands and labels of a pixel move together.

    Scenes of several sizes give theirs by columns.
    """
    lr, ud = uniform(seed, F.lit("lr"), F.col(key)) <= probability, uniform(seed, F.lit("ud"), F.col(key)) <= probability
    return pixels.withColumns({"x": F.when(lr, width - 1 - F.col("x")).otherwise(F.col("x")), "y": F.when(ud, height - 1 - F.col("y")).otherwise(F.col("y"))})


def applied(probability: float, seed: int, what: str, key: str) -> Column:
    """Whether the scene is changed at all."""
    return uniform(seed, F.lit(what + "?"), F.col(key)) <= probability


def brightness(value: Column, low: float, high: float, seed: int, *key: Column) -> Column:
    """Times one number in [low, high) for each key."""
    return value * (low + (high - low) * uniform(seed, F.lit("light"), *key))


def brightened(pixels: DataFrame, probability: float, seed: int, low: float = 0.5, high: float = 1.5, key: str = "scene_id", value: str = "value") -> DataFrame:
    """Each scene with the probability brighter or darker as a whole; labels stay."""
    return pixels.withColumn(value, F.when(applied(probability, seed, "light", key), brightness(F.col(value), low, high, seed, F.col(key))).otherwise(F.col(value)))


def reflected(at: Column, size: int | Column) -> Column:
    """An index mirrored at the edges, which are not repeated (period 2 size - 2)."""
    size = F.lit(size) if isinstance(size, int) else size
    period = F.greatest(F.lit(1), 2 * size - 2)
    p = F.pmod(at, period)
    return F.when(p < size, p).otherwise(period - p)


def translated(pixels: DataFrame, width: int | Column, height: int | Column, most: int, seed: int, key: str = "scene_id", probability: float = 1.0) -> DataFrame:
    """Each scene, labels and all, with the probability moved by its own (dx, dy) in [-most, most]; what comes in at an edge is the mirror image."""
    go = applied(probability, seed, "move", key)
    dx = F.when(go, F.floor(uniform(seed, F.lit("dx"), F.col(key)) * (2 * most + 1)) - most).otherwise(0)
    dy = F.when(go, F.floor(uniform(seed, F.lit("dy"), F.col(key)) * (2 * most + 1)) - most).otherwise(0)
    return moved(pixels, key, reflected(F.col("y") - dy, height), reflected(F.col("x") - dx, width))


def rotated(pixels: DataFrame, width: int | Column, height: int | Column, most: float, seed: int, key: str = "scene_id", probability: float = 1.0) -> DataFrame:
    """Each scene, labels and all, with the probability turned about its centre by its own angle in [-most, most) degrees.

    Nearest pixel, mirrored outside.
    """
    angle = F.when(applied(probability, seed, "turn", key), F.radians((2 * uniform(seed, F.lit("angle"), F.col(key)) - 1) * most)).otherwise(0.0)
    cy, cx = (height - 1) / 2, (width - 1) / 2
    y, x = F.col("y") - cy, F.col("x") - cx
    at_y = F.floor(F.cos(angle) * y - F.sin(angle) * x + cy + 0.5)
    at_x = F.floor(F.sin(angle) * y + F.cos(angle) * x + cx + 0.5)
    return moved(pixels, key, reflected(at_y, height), reflected(at_x, width))


def _drawn(step: str | dict, k: int, seed: int, keys: list[Column]) -> tuple[str, dict, Column]:
    """(name, arguments, draws) of the k-th step for one sample of one epoch: by seed, step, epoch and the sample's key alone."""
    name, args = (step, {}) if isinstance(step, str) else next(iter(step.items()))
    args = args or {}
    u = lambda what: uniform(seed, F.lit(f"{k}-{what}"), *keys)
    go = u("go") <= args.get("probability", 1.0 if "brightness" not in name else 0.5)
    if name in ("random_flip_left_right", "random_flip_up_down"):
        first, second = F.when(go, 1.0).otherwise(0.0), F.lit(0.0)
    elif name == "random_translate":
        most = args.get("max_pixels", 7)
        first, second = (F.when(go, F.floor(u(axis) * (2 * most + 1)) - most).otherwise(0).cast("double") for axis in ("dx", "dy"))
    elif name == "random_rotate":
        first, second = F.when(go, F.radians((2 * u("angle") - 1) * args.get("max_angle", 5.0))).otherwise(0.0), F.lit(0.0)
    elif name == "random_brightness":
        low, high = args.get("min_factor", 0.5), args.get("max_factor", 1.5)
        first, second = F.when(go, low + (high - low) * u("light")).otherwise(1.0), F.lit(0.0)
    else:
        raise ValueError(f"unknown augmentation {name}")
    return name, args, F.array(first, second)


def _places(names: list[str], draws: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of the changed samples comes from: [samples, h, w] rows and columns. The last step is undone first."""
    y, x = (np.broadcast_to(g, (len(draws), h, w)) for g in np.mgrid[:h, :w])
    each = lambda v: v[:, None, None]
    for k in range(len(names) - 1, -1, -1):
        first, second = draws[:, k, 0], draws[:, k, 1]
        if names[k] == "random_flip_left_right":
            x = np.where(each(first) > 0, w - 1 - x, x)
        elif names[k] == "random_flip_up_down":
            y = np.where(each(first) > 0, h - 1 - y, y)
        elif names[k] == "random_translate":
            y, x = kernels.mirror(y - each(second).astype(int), h), kernels.mirror(x - each(first).astype(int), w)
        elif names[k] == "random_rotate":
            cy, cx, cos, sin = (h - 1) / 2, (w - 1) / 2, each(np.cos(first)), each(np.sin(first))
            turned_y, turned_x = cos * (y - cy) - sin * (x - cx) + cy, sin * (y - cy) + cos * (x - cx) + cx
            y, x = kernels.mirror(np.floor(turned_y + 0.5).astype(int), h), kernels.mirror(np.floor(turned_x + 0.5).astype(int), w)
    return y, x


def augment_samples(samples: DataFrame, steps: list, key: list[str], size: tuple[int, int], label_size: tuple[int, int] | None = None, seed: int = 0, epochs: int = 1, image: str = "image", label: str = "label") -> DataFrame:
    """``samples`` once for each ``epoch`` from 0, image and label changed together by the steps, each time anew.

    Samples are arrays of one ``size`` (rows, columns) with any number of bands, whatever the size of the scenes that they were
    cut from; labels may be smaller and are changed about their own centre. A step is a name or a dict of a name and its
    arguments (random_flip_left_right, random_flip_up_down, random_translate, random_rotate, random_brightness). What is drawn
    depends on seed, step, epoch and key only, so a rerun and any partitioning give the same. Nothing is shuffled: a sample
    is changed where it is, a batch of them at a time. Outside a sample is its mirror image; brightness leaves labels alone.
    """
    label_size = label_size or size
    rows = samples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    made = [_drawn(step, k, seed, [F.col("epoch"), *map(F.col, key)]) for k, step in enumerate(steps)]
    names = [name for name, _, _ in made]
    rows = rows.withColumn("_draws", F.flatten(F.array(*[d for _, _, d in made])) if made else F.array().cast("array<double>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_draws")

    def change(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), BATCH):
                part = f.iloc[at : at + BATCH]
                draws = np.stack(part["_draws"].to_numpy()).reshape(len(part), len(names), 2)
                rows_ = np.arange(len(part))[:, None, None]
                done = {}
                for column, (h, w) in ((image, size), (label, label_size)):
                    whole = np.stack(part[column].to_numpy()).reshape(len(part), h, w, -1)
                    y, x = _places(names, draws, h, w)
                    out = whole[rows_, y, x]
                    if column == image:
                        for k, name in enumerate(names):
                            out = (out * draws[:, k, 0][:, None, None, None]).astype(out.dtype) if name == "random_brightness" else out
                    done[column] = list(out.reshape(len(part), -1))
                yield part.drop(columns="_draws").assign(**done)

    return rows.mapInPandas(change, schema)


def centre_crop(pixels: DataFrame, width: int, height: int, out_width: int, out_height: int, fill: dict | None = None) -> DataFrame:
    """The middle of each scene, (in - out) // 2 off on each side, from (0, 0) on.

    An output larger than the scene is the scene in its middle; the rest is what ``fill`` says, or left out if ``fill`` is None.
    """
    top, left = (height - out_height) // 2, (width - out_width) // 2
    inside = pixels.withColumns({"y": (F.col("y") - top).cast("int"), "x": (F.col("x") - left).cast("int")})
    inside = inside.filter(F.col("y").between(0, out_height - 1) & F.col("x").between(0, out_width - 1))
    if fill is None:
        return inside
    rows = pixels.select("scene_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(out_height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out_width - 1))))
    return rows.join(inside, ["scene_id", "y", "x"], "left").fillna(fill)


#: Augmentations by name; each takes the pixels of scenes of one size and moves or changes bands and labels together.
AUGMENTATIONS: dict[str, Callable[..., DataFrame]] = {}


def map_tiles(tiles: DataFrame, kernel: Callable, out: str = "data") -> DataFrame:
    """Applies a NumPy function (array[h, w, bands], scene) -> array[h, w, bands] to each tile's ``data``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = []
            for scene, h, w, b, data in zip(f["scene_id"], f["height"], f["width"], f["n_bands"], f["data"]):
                done.append(kernel(kernels.grid(data, h, w, b), scene).reshape(-1).astype("float32"))
            yield f.assign(**{out: done})

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in tiles.schema if x.name != out) + f", `{out}` array<float>"
    return tiles.mapInPandas(run, ", ".join(f"`{x.name}` " + ("array<float>" if x.name == out else x.dataType.simpleString()) for x in tiles.schema) if out in tiles.columns else schema)


def augment(data: DataFrame, steps: list, registry: dict[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """Applies named steps in the order of the list; a step is a name or a dict of one name and its arguments."""
    registry = AUGMENTATIONS if registry is None else registry
    for step in steps:
        name, args = (step, {}) if isinstance(step, str) else next(iter(step.items()))
        if name not in registry:
            raise ValueError(f"unknown augmentation {name}")
        data = registry[name](data, **(args or {}))
    return data


AUGMENTATIONS |= {"random_flip": flips, "random_translate": translated, "random_rotate": rotated, "random_brightness": brightened}
