"""Half-open boxes ``[min_x, max_x) x [min_y, max_y)`` as struct columns, and pixel/geo coordinates.

A box column is ``struct<min_x, min_y, max_x, max_y>``. NULL boxes give NULL results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("min_x", "min_y", "max_x", "max_y")


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def box_of(prefix: str = "") -> Column:
    """The box in the four columns ``<prefix>min_x`` and so on."""
    return box(*[F.col(prefix + s) for s in SIDES])


def width(b: Column) -> Column:
    return b["max_x"] - b["min_x"]


def height(b: Column) -> Column:
    return b["max_y"] - b["min_y"]


def has_area(b: Column) -> Column:
    return (width(b) > 0) & (height(b) > 0)


def area(b: Column) -> Column:
    """0 unless both sides are positive."""
    return F.when(has_area(b), width(b) * height(b)).otherwise(F.lit(0))


def perimeter(b: Column) -> Column:
    return 2 * width(b) + 2 * height(b)


def shift(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["min_x"] + dx, b["min_y"] + dy, b["max_x"] + dx, b["max_y"] + dy)


def scale(b: Column, by_x: Column, by_y: Column | None = None) -> Column:
    """``by_y`` is ``by_x`` if not given."""
    by_y = by_x if by_y is None else by_y
    return box(b["min_x"] * by_x, b["min_y"] * by_y, b["max_x"] * by_x, b["max_y"] * by_y)


def expand(b: Column, left: Column, down: Column, right: Column | None = None, up: Column | None = None) -> Column:
    """Right and up are left and down if not given."""
    return box(b["min_x"] - left, b["min_y"] - down, b["max_x"] + (left if right is None else right), b["max_y"] + (down if up is None else up))


def intersection(a: Column, b: Column) -> Column:
    """May be empty: then a side is zero or negative."""
    return box(F.greatest(a["min_x"], b["min_x"]), F.greatest(a["min_y"], b["min_y"]), F.least(a["max_x"], b["max_x"]), F.least(a["max_y"], b["max_y"]))


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["min_x"], b["min_x"]), F.least(a["min_y"], b["min_y"]), F.greatest(a["max_x"], b["max_x"]), F.greatest(a["max_y"], b["max_y"]))


def contains_point(b: Column, x: Column, y: Column) -> Column:
    """Inclusive on all sides."""
    return (x >= b["min_x"]) & (x <= b["max_x"]) & (y >= b["min_y"]) & (y <= b["max_y"])


def contains_box(a: Column, b: Column) -> Column:
    return (b["min_x"] >= a["min_x"]) & (b["max_x"] <= a["max_x"]) & (b["min_y"] >= a["min_y"]) & (b["max_y"] <= a["max_y"])


def overlaps(a: Column, b: Column) -> Column:
    """Touching edges are no overlap."""
    return has_area(intersection(a, b))


def snap_to_blocks(region: Column, bounds: Column, block_x: int, block_y: int) -> Column:
    """The region grown to whole blocks of the grid, cut to the bounds; NULL where it reaches outside the bounds."""

    def low(side: str, step: int) -> Column:
        return F.floor(region[side] / step) * step

    def high(side: str, step: int) -> Column:
        return (F.floor((region[side] - 1) / step) + 1) * step

    grown = box(low("min_x", block_x), low("min_y", block_y), high("max_x", block_x), high("max_y", block_y))
    return F.when(contains_box(bounds, region), intersection(grown, bounds))


def truncated(v: Column) -> Column:
    """Towards zero."""
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))


def pixel_to_geo(transform: Column, x: Column, y: Column) -> Column:
    """struct<gx, gy>; ``transform`` is the affine array of six without rotation."""
    return F.struct((transform[0] + x * transform[1]).alias("gx"), (transform[3] + y * transform[5]).alias("gy"))


def geo_to_pixel(transform: Column, gx: Column, gy: Column) -> Column:
    return F.struct(truncated((gx - transform[0]) / transform[1]).alias("x"), truncated((gy - transform[3]) / transform[5]).alias("y"))


def footprint(transform: Column, w: Column, h: Column) -> Column:
    """The geo box of a raster: top left and bottom right corners, sorted."""
    gx, gy = transform[0] + w * transform[1], transform[3] + h * transform[5]
    return box(F.least(transform[0], gx), F.least(transform[3], gy), F.greatest(transform[0], gx), F.greatest(transform[3], gy))
