"""Expressions on the bands of a pixel (``array<double>``; a NULL element is nodata) and on class codes.

All are built-in expressions that run in the JVM and can be chained without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The factor that ``scale`` divides by where none is given, by kind of image.
DEFAULT_SCALE = {"tiff": 1024.0, "worldview": 1024.0, "landsat": 120.0}


def scale(bands: Column, factor: float | None = None, image_type: str | None = None) -> Column:
    """Divides by the factor; one has to be given or be known for the kind of image."""
    factor = DEFAULT_SCALE.get(image_type) if factor is None else factor
    if factor is None:
        raise ValueError(f"no scale factor for {image_type}")
    return F.transform(bands, lambda b: b / float(factor))


def offset(bands: Column, factor: float) -> Column:
    return F.transform(bands, lambda b: b + float(factor))


def clip(bands: Column, bounds: float | tuple[float, float]) -> Column:
    """One number is both bounds. NULL stays NULL."""
    low, high = bounds if isinstance(bounds, (tuple, list)) else (bounds, bounds)
    return F.transform(bands, lambda b: F.when(b < low, float(low)).when(b > high, float(high)).otherwise(b))


def sqrt(bands: Column) -> Column:
    """NaN below 0."""
    return F.transform(bands, F.sqrt)


def cbrt(bands: Column) -> Column:
    return F.transform(bands, F.cbrt)


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only, not on partitions or order."""
    parts = [F.lit(str(seed)), *[k.cast("string") for k in key]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def gauss_mult_noise(bands: Column, stddev: float, seed: int, *key: Column) -> Column:
    """Every value times a normal number of mean 1, drawn for (seed, key, band)."""

    def drawn(b: Column, i: Column) -> Column:
        u, v = uniform(seed, *key, i, F.lit("u")), uniform(seed, *key, i, F.lit("v"))
        return b * (1 + stddev * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v))

    return F.transform(bands, drawn)


def substitute(value: Column, mapping: list) -> Column:
    """The entry of the list that the value counts to; entries may be numbers or lists (one-hot). NULL outside the list."""
    entries = [F.array(*map(F.lit, m)) if isinstance(m, (list, tuple)) else F.lit(m) for m in mapping]
    return F.get(F.array(*entries), value.cast("int"))


STEPS: dict[str, Callable[..., Column]] = {"scale": scale, "offset": offset, "clip": clip, "sqrt": sqrt, "cbrt": cbrt}


def chain(bands: Column, steps: list, registry: dict[str, Callable[..., Column]] | None = None) -> Column:
    """Applies named steps in the order of the list; a step is a name or a dict of one name and its arguments."""
    known = STEPS if registry is None else registry
    for step in steps:
        name, args = (step, {}) if isinstance(step, str) else next(iter(step.items()))
        if name not in known:
            raise ValueError(f"unknown step {name}")
        bands = known[name](bands, **(args or {}))
    return bands


def toa_radiance(bands: Column, mult: Column, add: Column) -> Column:
    """v * mult + add per band where v > 0, else 0; ``mult`` and ``add`` are arrays by band."""
    return F.transform(F.arrays_zip(bands.alias("v"), mult.alias("m"), add.alias("a")), lambda z: F.when(z["v"] > 0, z["v"] * z["m"] + z["a"]).otherwise(0.0))


def toa_temperature(bands: Column, mult: Column, add: Column, k1: Column, k2: Column) -> Column:
    """Brightness temperature k2 / ln(k1 / radiance + 1) per band with the band's own constants, 0 where v is not positive."""
    rows = F.arrays_zip(bands.alias("v"), mult.alias("m"), add.alias("a"), k1.alias("p"), k2.alias("q"))
    return F.transform(rows, lambda z: F.when(z["v"] > 0, F.try_divide(z["q"], F.log(F.try_divide(z["p"], z["v"] * z["m"] + z["a"]) + 1))).otherwise(0.0))


def toa_reflectance(bands: Column, mult: Column, add: Column, sun_elevation: Column) -> Column:
    """Radiance form over the sine of the scene's sun elevation in degrees."""
    sine = F.sin(F.radians(sun_elevation))
    return F.transform(toa_radiance(bands, mult, add), lambda r: F.when(r == 0, 0.0).otherwise(r / sine))


def toa_landsat(bands: Column, c: Column) -> Column:
    """Temperature for bands that have k1, reflectance for the others. ``c``: struct of arrays and ``sun_elevation``."""
    warm = toa_temperature(bands, c["mult"], c["add"], c["k1"], c["k2"])
    bright = toa_reflectance(bands, c["rmult"], c["radd"], c["sun_elevation"])
    return F.transform(F.arrays_zip(warm.alias("w"), bright.alias("b"), c["k1"].alias("k")), lambda z: F.when(z["k"].isNull(), z["b"]).otherwise(z["w"]))


def toa_worldview(bands: Column, abscal: Column, bandwidth: Column) -> Column:
    return F.transform(F.arrays_zip(bands.alias("v"), abscal.alias("c"), bandwidth.alias("w")), lambda z: F.when(z["v"] > 0, z["v"] * z["c"] / z["w"]).otherwise(0.0))


def mask_nodata(value: Column, bands: Column, nodata: float) -> Column:
    """NULL where the first band is nodata, NaN or infinite."""
    first = F.get(bands, F.lit(0))
    bad = (first == nodata) | F.isnan(first) | (F.abs(first) == float("inf"))
    return F.when(~bad, value)


def decide(probs: Column, binary: bool = False, threshold: float = 0.5) -> Column:
    """The class: p >= threshold for one output, else the first largest."""
    if binary:
        return (F.get(probs, F.lit(0)) >= threshold).cast("int")
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def probability_byte(p: Column) -> Column:
    """1..255 for p in [0, 1], 0 for nodata."""
    return F.coalesce(1 + F.least(F.lit(254), F.greatest(F.lit(0), F.floor(p * 254))), F.lit(0)).cast("short")


def _byte(v: Column) -> Column:
    return F.coalesce(F.least(F.lit(255), F.greatest(F.lit(1), F.floor(v))), F.lit(0)).cast("short")


def error_byte(p: Column, label: Column) -> Column:
    """Signed error of a binary score around 128, 0 for nodata."""
    return _byte((p - label) * 127 + 128)


def absolute_error_byte(p: Column, label: Column) -> Column:
    return _byte(F.abs(p - label) * 254 + 1)


def class_sink(cls: Column) -> Column:
    """Nodata is written as -1."""
    return F.coalesce(cls, F.lit(-1)).cast("int")


def unpack_colour(c: Column) -> Column:
    return F.struct(F.shiftright(c, 16).bitwiseAND(255).alias("r"), F.shiftright(c, 8).bitwiseAND(255).alias("g"), c.bitwiseAND(255).alias("b"))


def blend_colours(probs: Column, palette: list[int]) -> Column:
    """Per channel the sum of colour times probability over the classes, cut to whole numbers."""

    def channel(shift: int) -> Column:
        shades = F.array(*[F.lit(float(c >> shift & 255)) for c in palette])
        return F.floor(F.aggregate(F.zip_with(probs, shades, lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)).cast("int")

    return F.struct(channel(16).alias("r"), channel(8).alias("g"), channel(0).alias("b"))


def class_colour(cls: Column, palette: list[int], old_binary: bool = False) -> Column:
    """The class's own colour; with ``old_binary`` class 1 shows the first colour and class 0 black, as older outputs do."""
    if old_binary:
        return F.when(cls == 1, F.lit(palette[0])).when(cls == 0, F.lit(0))
    return F.get(F.array(*map(F.lit, palette)), cls)


def select_bands(bands: Column, chosen: list[int]) -> Column:
    """Zero-based, in the given order."""
    return F.array(*[F.get(bands, F.lit(b)) for b in chosen])


def stretch_to_rgb(bands: Column, chosen: list[int], factor: float = 100.0) -> Column:
    return F.transform(select_bands(bands, chosen), lambda b: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), b * factor))).cast("int"))
