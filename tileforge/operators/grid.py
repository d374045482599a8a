"""Tile grids over scenes, pixels to tiles and back, and box joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.pixels import select_bands


def make_tile_grid(scenes: DataFrame, tile: tuple[int, int], overlap: tuple[int, int] = (0, 0), partials: bool = True, least: tuple[int, int] = (0, 0), shift_back: bool = False, rect: Column | None = None, container: Column | None = None) -> DataFrame:
    """The tiles of every scene: ``tile_row, tile_col``, ``tile`` and the part it owns, ``valid``.

    Pairs are (x, y). ``rect`` is the scene's box and ``container`` what tiles may reach into (the rect, if not given).
    ``partials`` keeps edge tiles, cut to the rect, from ``least`` in size; otherwise tiles that stick out of the container
    are dropped, or with ``shift_back`` moved until they end on its edge. The owner box loses half the overlap on every
    inner edge and is taken from the tile before any shift: with an odd overlap neighbours both own one row of pixels.
    A scene smaller than the overlap has no tiles. A narrow projection with two explodes; nothing is shuffled.
    """
    rect = G.box(F.lit(0), F.lit(0), F.col("width"), F.col("height")) if rect is None else rect
    container = rect if container is None else container
    step = (tile[0] - overlap[0], tile[1] - overlap[1])
    if min(step) <= 0:
        raise ValueError("the overlap must be smaller than the tile")
    rows = scenes.withColumns({"_rect": rect, "_within": container})

    def count(size: Column, inside: Column, k: int) -> Column:
        n = F.ceil((size - overlap[k]) / step[k])
        return n if partials or shift_back else F.least(n, F.floor((inside - overlap[k]) / step[k]))

    rows = rows.withColumns({"_nx": count(G.width(F.col("_rect")), G.width(F.col("_within")), 0), "_ny": count(G.height(F.col("_rect")), G.height(F.col("_within")), 1)})
    rows = rows.filter((F.col("_nx") > 0) & (F.col("_ny") > 0))
    rows = rows.withColumn("tile_row", F.explode(F.sequence(F.lit(0), (F.col("_ny") - 1).cast("int"))))
    rows = rows.withColumn("tile_col", F.explode(F.sequence(F.lit(0), (F.col("_nx") - 1).cast("int"))))
    r, c, whole, within = F.col("tile_row"), F.col("tile_col"), F.col("_rect"), F.col("_within")
    x, y = whole["min_x"] + c * step[0], whole["min_y"] + r * step[1]
    full = G.box(x, y, x + tile[0], y + tile[1])
    half = (overlap[0] // 2, overlap[1] // 2)
    owned = G.box(
        x + F.when(c > 0, half[0]).otherwise(0),
        y + F.when(r > 0, half[1]).otherwise(0),
        x + tile[0] - F.when(c < F.col("_nx") - 1, half[0]).otherwise(0),
        y + tile[1] - F.when(r < F.col("_ny") - 1, half[1]).otherwise(0),
    )
    if partials:
        tile_box = G.intersection(full, whole)
        keep = (G.width(F.col("tile")) >= least[0]) & (G.height(F.col("tile")) >= least[1])
    else:
        right, bottom = F.least(full["max_x"], within["max_x"]), F.least(full["max_y"], within["max_y"])
        back = G.box(right - tile[0], bottom - tile[1], right, bottom)
        tile_box = F.when(G.contains_box(within, full), full).otherwise(back) if shift_back else full
        keep = G.contains_box(F.col("_within"), F.col("tile"))
    rows = rows.withColumns({"tile": tile_box, "valid": G.intersection(owned, whole)}).filter(keep)
    return rows.drop("_rect", "_within", "_nx", "_ny")


def make_tile_grid_yx(scenes: DataFrame, tile: tuple[int, int], overlap: tuple[int, int] = (0, 0), least: tuple[int, int] = (0, 0), **more) -> DataFrame:
    """``make_tile_grid`` with all pairs as (y, x)."""
    return make_tile_grid(scenes, tile[::-1], overlap[::-1], least=least[::-1], **more)


def group_by_row_block(grid: DataFrame, key: str = "scene_id") -> DataFrame:
    """One row for each tile row: its block, and the tiles relative to the block, in column order."""
    rows = grid.groupBy(key, "tile_row").agg(F.array_sort(F.collect_list(F.struct("tile_col", "tile", "valid"))).alias("tiles"))
    first, last = F.get("tiles", F.lit(0))["tile"], F.get("tiles", F.size("tiles") - 1)["tile"]
    block = G.box(first["min_x"], first["min_y"], last["max_x"], last["max_y"])
    rows = rows.withColumn("block", block)
    dx, dy = -F.col("block.min_x"), -F.col("block.min_y")
    return rows.withColumn("tiles", F.transform("tiles", lambda t: F.struct(t["tile_col"].alias("tile_col"), G.shift(t["tile"], dx, dy).alias("tile"), G.shift(t["valid"], dx, dy).alias("valid"))))


def tiles_to_pixels(tiles: DataFrame, data: str = "data") -> DataFrame:
    """One row per pixel, ``bands`` as an array. ``data`` is row-major (y, x, band) from (min_x, min_y)."""
    n, w = F.col("n_bands"), F.col("max_x") - F.col("min_x")
    at = F.explode(F.sequence(F.lit(0), (F.size(data) / n - 1).cast("int")))
    rows = tiles.filter(F.size(data) >= n).withColumn("_at", at)
    return rows.select("scene_id", (F.col("min_y") + F.floor(F.col("_at") / w)).cast("int").alias("y"), (F.col("min_x") + F.col("_at") % w).cast("int").alias("x"), F.slice(data, F.col("_at") * n + 1, n).alias("bands"))


def pixels_to_tiles(pixels: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Tiles of ``tile_w x tile_h`` (edge tiles shorter); every pixel of a tile's bounding box must be there."""
    rows = pixels.withColumns({"tile_row": F.floor(F.col("y") / tile_h).cast("int"), "tile_col": F.floor(F.col("x") / tile_w).cast("int")})
    out = rows.groupBy("scene_id", "tile_row", "tile_col").agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), (F.max("x") + 1).alias("max_x"), (F.max("y") + 1).alias("max_y"),
        F.max(F.size("bands")).alias("n_bands"), F.array_sort(F.collect_list(F.struct("y", "x", "bands"))).alias("_px"))
    return out.withColumn("data", F.flatten(F.transform("_px", lambda p: p["bands"]))).drop("_px")


def covering_tiles(pixels: DataFrame, tile: int, overlap: int, size_x: Column, size_y: Column) -> DataFrame:
    """Every tile (of side ``tile``, neighbours sharing ``overlap``) that covers the pixel, and whether it owns it.

    The covering indices follow from the coordinates alone; a pixel explodes into the few tiles it lies in, no join.
    """
    step, half = tile - overlap, overlap // 2

    def last(size: Column) -> Column:
        return F.greatest(F.ceil((size - overlap) / step) - 1, F.lit(0)).cast("int")

    def indices(at: str, size: Column) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - tile + 1) / step)).cast("int")
        high = F.least(F.floor(F.col(at) / step), last(size)).cast("int")
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def owned(at: str, index: str, size: Column) -> Column:
        i = F.col(index)
        start = i * step + F.when(i > 0, half).otherwise(0)
        end = i * step + tile - F.when(i < last(size), half).otherwise(0)
        return (F.col(at) >= start) & (F.col(at) < end)

    rows = pixels.withColumn("tile_row", F.explode(indices("y", size_y))).withColumn("tile_col", F.explode(indices("x", size_x)))
    return rows.withColumn("owned", owned("x", "tile_col", size_x) & owned("y", "tile_row", size_y))


def bounding_box(boxes: DataFrame, box: Column, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(G.box(F.min(box["min_x"]), F.min(box["min_y"]), F.max(box["max_x"]), F.max(box["max_y"])).alias("box"))


def box_with_points(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """The least half-open box that holds all points: its far sides are 1 beyond whole-number points, else 0.001."""

    def far(c: str) -> Column:
        return F.max(c) + F.lit(1 if points.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else 0.001)

    return points.groupBy(*keys).agg(G.box(F.min(x), F.min(y), far(x), far(y)).alias("box"))


def read_window(pixels: DataFrame, window: tuple[int, int, int, int], size: tuple[int, int], bands: list[int] | None = None) -> DataFrame:
    """The pixels of a window (min_x, min_y, max_x, max_y) and, of these, the bands in the given order.

    The window has to lie inside the image of ``size`` (width, height).
    """
    x0, y0, x1, y1 = window
    if not (0 <= x0 <= x1 <= size[0] and 0 <= y0 <= y1 <= size[1]):
        raise ValueError(f"the window {window} is not inside an image of {size}")
    rows = pixels.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return rows if bands is None else rows.withColumn("bands", select_bands(F.col("bands"), bands))


#: Boxes of one side that are sent to every task.
SENT_BOXES = 20_000


def box_overlap_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: int, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of rows whose boxes overlap (touching is no overlap) and that agree in the columns of ``on``.

    Grids of cells of side ``cell``, 2 ``cell``, 4 ``cell`` and so on: a box belongs to the first whose cells are no smaller
    than it, so that it lies in four of them at most, however large it is. Two boxes meet in the grid of the larger one, in
    the cell that holds the lower left corner of their intersection, so every pair comes once and no distinct is needed.
    ``cell`` should be near the median box size.

    Boxes are counted by grid first. Grids that hold few boxes, as those of very large boxes do, are sent to every task, so that
    one box over the whole plane does not gather all others at its key; only grids of many boxes are shuffled, by cell.
    """

    def levelled(df: DataFrame, b: str) -> DataFrame:
        side = F.greatest(G.width(F.col(b)), G.height(F.col(b))) / F.lit(float(cell))
        return df.filter(G.has_area(F.col(b))).withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log2(side))).cast("int"))

    sides = [(levelled(left, left_box), left_box), (levelled(right, right_box), right_box)]
    counts = [{r["_own"]: r["count"] for r in df.groupBy("_own").count().collect()} for df, _ in sides]  # a row for each grid

    def cells(df: DataFrame, b: str, level: Column) -> DataFrame:
        df = df.withColumn("_level", level)
        size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))

        def span(lo: str, hi: str) -> Column:
            # the last cell is that of the far edge, which the box does not hold: an empty meeting at most
            return F.sequence(F.floor(F.col(f"{b}.{lo}") / size), F.ceil(F.col(f"{b}.{hi}") / size) - 1)

        return df.withColumn("_cx", F.explode(span("min_x", "max_x"))).withColumn("_cy", F.explode(span("min_y", "max_y"))).drop("_own")

    met = G.intersection(F.col(left_box), F.col(right_box))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    here = (F.floor(met["min_x"] / size) == F.col("_cx")) & (F.floor(met["min_y"] / size) == F.col("_cy"))
    keys = [*on, "_level", "_cx", "_cy"]
    out = None
    for large, small, above in ((1, 0, 0), (0, 1, 1)):  # boxes of one grid meet once, with the right ones as the larger
        sent, total = [], 0
        for level, n in sorted(counts[large].items(), key=lambda x: x[1]):
            total += n
            if total > SENT_BOXES:
                break
            sent.append(level)
        for levels, near in ((sent, True), ([x for x in counts[large] if x not in sent], False)):
            if not levels or not counts[small]:
                continue
            (big, big_box), (little, little_box) = sides[large], sides[small]
            big = cells(big.filter(F.col("_own").isin(levels)), big_box, F.col("_own"))
            higher = F.explode(F.filter(F.array(*map(F.lit, sorted(levels))), lambda x: x >= F.col("_own") + above))
            little = cells(little, little_box, higher)
            pairs = (little.join(F.broadcast(big) if near else big, keys) if small == 0 else (F.broadcast(big) if near else big).join(little, keys)).filter(G.overlaps(F.col(left_box), F.col(right_box)) & here).drop("_level", "_cx", "_cy")
            out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        return left.join(right, list(on)).limit(0) if on else left.crossJoin(right.limit(0)).limit(0)
    return out
