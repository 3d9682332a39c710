"""Raster tables in long form: pixels(image_id, r, c, band, v). Tiles and stencils are in tiles.py."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..session import multiplied
from .cameras import small

CELL = ["image_id", "r", "c"]

# -- images ------------------------------------------------------------------------------------


def raster_meta(pixels: DataFrame) -> DataFrame:
    """Rows, columns and bands of each image."""
    return pixels.groupBy("image_id").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count_distinct("band").alias("bands"))


def create_rasters(headers: DataFrame) -> DataFrame:
    """image_id, r, c of every cell of the images of a header table (image_id, rows, cols); images without cells give none."""
    sized = headers.filter((F.col("rows") > 0) & (F.col("cols") > 0))
    lines = sized.select("image_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"))
    return multiplied(lines.select("image_id", "r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c")))


def create_raster(spark, image_id: int, rows: int, cols: int, value: float | None = None) -> DataFrame:
    at = spark.range(rows * cols)
    return at.select(F.lit(image_id).cast("long").alias("image_id"), F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"), F.lit(0).alias("band"), F.lit(value).cast("double").alias("v"))


def fill_value(pixels: DataFrame, value: float) -> DataFrame:
    return pixels.withColumn("v", F.lit(float(value)))


def read_patch(pixels: DataFrame, rois: DataFrame, meta: DataFrame) -> DataFrame:
    """roi_id, r, c, band, v: each region of interest at its target size, by the nearest pixel.

    rois: roi_id, image_id, r0, c0, rows, cols, out_rows, out_cols. A region that is not inside its image
    gives nothing. Target pixel centres map to origin pixels by (i + 0.5) * rows / out_rows - 0.5.
    """
    inside = rois.join(meta.select("image_id", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols")), "image_id").filter("r0 >= 0 and c0 >= 0 and rows > 0 and cols > 0 and out_rows > 0 and out_cols > 0 and r0 + rows <= n_rows and c0 + cols <= n_cols")
    grid = inside.select("*", F.explode(F.sequence(F.lit(0), F.col("out_rows") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("out_cols") - 1)).alias("j"))
    at = lambda origin, k, n, out: F.least(F.col(origin) + F.col(n) - 1, F.col(origin) + F.floor((F.col(k) + 0.5) * F.col(n) / F.col(out))).cast("int")
    wanted = grid.select("roi_id", "image_id", F.col("i").alias("out_r"), F.col("j").alias("out_c"), at("r0", "i", "rows", "out_rows").alias("r"), at("c0", "j", "cols", "out_cols").alias("c"))
    return multiplied(wanted).join(pixels, CELL).select("roi_id", F.col("out_r").alias("r"), F.col("out_c").alias("c"), "band", "v")


def patch_affine(rois: DataFrame) -> DataFrame:
    """roi_id and the affine map from target to origin pixels, half-pixel rule included."""
    sy, sx = F.col("rows") / F.col("out_rows"), F.col("cols") / F.col("out_cols")
    return rois.select("roi_id", sx.alias("a00"), F.lit(0.0).alias("a01"), (F.col("c0") + 0.5 * sx - 0.5).alias("a02"), F.lit(0.0).alias("a10"), sy.alias("a11"), (F.col("r0") + 0.5 * sy - 0.5).alias("a12"))


def read_image(pixels: DataFrame, meta: DataFrame, out_rows: int, out_cols: int) -> DataFrame:
    """Whole images at a target size."""
    rois = meta.select(F.col("image_id").alias("roi_id"), "image_id", F.lit(0).alias("r0"), F.lit(0).alias("c0"), "rows", "cols", F.lit(out_rows).alias("out_rows"), F.lit(out_cols).alias("out_cols"))
    return read_patch(pixels, rois, meta)


def write_patch(pixels: DataFrame, patch: DataFrame, r0: int, c0: int) -> DataFrame:
    """pixels with the values of patch (image_id, r, c, band, v; r and c from its corner) written at (r0, c0); cells outside stay out."""
    new = patch.select("image_id", (F.col("r") + r0).alias("r"), (F.col("c") + c0).alias("c"), "band", F.col("v").alias("new_v"))
    return pixels.join(new, [*CELL, "band"], "left").withColumn("v", F.coalesce("new_v", "v")).drop("new_v")


# -- coordinates --------------------------------------------------------------------------------


def to_world(a: list, x: Column, y: Column) -> tuple[Column, Column]:
    """a: 2 x 3 (numbers or columns): pixel to world."""
    return a[0] * x + a[1] * y + a[2], a[3] * x + a[4] * y + a[5]


def invert_affine(a: list) -> list[Column]:
    a = [x if isinstance(x, Column) else F.lit(float(x)) for x in a]
    d = a[0] * a[4] - a[1] * a[3]
    b = [F.try_divide(x, d) for x in (a[4], -a[1], -a[3], a[0])]
    return [b[0], b[1], -(b[0] * a[2] + b[1] * a[5]), b[2], b[3], -(b[2] * a[2] + b[3] * a[5])]


def corner_to_centre(a: list) -> list[Column]:
    """Affine of pixel corners to affine of pixel centres."""
    a = [x if isinstance(x, Column) else F.lit(float(x)) for x in a]
    return [a[0], a[1], a[2] + 0.5 * (a[0] + a[1]), a[3], a[4], a[5] + 0.5 * (a[3] + a[4])]


def get_cell(p: Column) -> Column:
    """Cell of a coordinate: towards zero of p + 0.5."""
    return (p + 0.5).cast("int")


def get_cell_bounded(p: Column, n: Column | int) -> Column:
    """The cell, clamped to the image; null stays null."""
    cell = get_cell(p)
    top = n - 1 if isinstance(n, Column) else F.lit(n - 1)
    return F.when(cell.isNotNull(), F.greatest(F.lit(0), F.least(top, cell)))


def point_in_bound(x: Column, y: Column, rows: int, cols: int) -> Column:
    return (get_cell(x) >= 0) & (get_cell(x) < cols) & (get_cell(y) >= 0) & (get_cell(y) < rows)


# -- values -------------------------------------------------------------------------------------


def raster_minmax(pixels: DataFrame, by: list[str] = ["image_id"], mask: Column | None = None) -> DataFrame:
    rows = pixels if mask is None else pixels.filter(mask)
    return rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def raster_stats(pixels: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and population deviation of each band."""
    return pixels.groupBy("image_id", "band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def percent_clip(pixels: DataFrame, percent: float = 2.0, by: list[str] = ["image_id"], bins: int = 256) -> DataFrame:
    """lo, hi: left edges of the first histogram bins whose cumulated share exceeds percent and 100 - percent."""
    box = pixels.groupBy(*by).agg(F.min("v").alias("v0"), ((F.max("v") - F.min("v")) / bins).alias("step"), F.count("v").alias("total"))
    b = F.when(F.col("step") > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("v0")) / F.col("step")))).otherwise(0)
    counted = pixels.filter("v is not null").join(small(box), by).groupBy(*by, b.alias("bin"), "v0", "step", "total").agg(F.count(F.lit(1)).alias("n"))
    share = F.sum("n").over(Window.partitionBy(*by).orderBy("bin")) * 100.0 / F.col("total")
    edge = F.col("v0") + F.col("step") * F.col("bin")
    cumulated = counted.withColumn("share", share).withColumn("edge", edge)
    return cumulated.groupBy(*by).agg(F.min(F.when(F.col("share") > percent, F.col("edge"))).alias("lo"), F.min(F.when(F.col("share") > 100 - percent, F.col("edge"))).alias("hi"))


def stretch_8u(pixels: DataFrame, limits: DataFrame) -> DataFrame:
    """v to 1..255 between lo and hi of its image, clipped; null (no data) becomes 0."""
    j = pixels.join(small(limits), "image_id")
    scaled = F.round(1 + (F.col("v") - F.col("lo")) * F.try_divide(F.lit(254.0), F.col("hi") - F.col("lo")))
    return j.withColumn("u8", F.coalesce(clip(scaled, 1.0, 255.0), F.lit(0.0)).cast("int")).drop("lo", "hi")


def lut_value(v: Column, lo: float, hi: float, top: int = 255) -> Column:
    """Piecewise linear, flat beyond lo and hi."""
    return F.floor(clip((v - lo) / (hi - lo), 0.0, 1.0) * top + 0.5).cast("int")


def lut_table(spark, lo: float, hi: float, top: int = 255) -> DataFrame:
    """The 65536 rows of the 16 to 8 bit table."""
    return spark.range(1 << 16).select(F.col("id").cast("int").alias("code"), lut_value(F.col("id"), lo, hi, top).alias("u8"))


def apply_lut(pixels: DataFrame, table: DataFrame) -> DataFrame:
    return pixels.join(F.broadcast(table), F.col("v").cast("int") == F.col("code")).drop("code")  # 65536 rows


def extract_channel(pixels: DataFrame, band: int) -> DataFrame:
    return pixels.filter(F.col("band") == band)


def copy_channel(target: DataFrame, source: DataFrame, mask: DataFrame) -> DataFrame:
    """target with the values of source where mask (image_id, r, c) has a row."""
    new = source.join(mask.select(*CELL), CELL, "left_semi").select(*CELL, "band", F.col("v").alias("new_v"))
    return target.join(new, [*CELL, "band"], "left").withColumn("v", F.coalesce("new_v", "v")).drop("new_v")


def colorize(pixels: DataFrame, ramp: DataFrame, n: int, lo: float, hi: float) -> DataFrame:
    """red, green, blue (0..255) by the place of v between lo and hi on a ramp of n colours (idx, red, green, blue in 0..1); null v gives 0."""
    place = clip((F.col("v") - lo) / (hi - lo), 0.0, 1.0) * (n - 1)
    p = pixels.withColumn("place", place).withColumn("below", F.floor("place").cast("int")).withColumn("above", F.ceil("place").cast("int"))
    side = lambda k, s: F.broadcast(ramp.select(F.col("idx").alias(k), *(F.col(c).alias(c + s) for c in ("red", "green", "blue"))))
    j = p.join(side("below", "_b"), "below", "left").join(side("above", "_a"), "above", "left")
    mixed = {c: F.coalesce(F.floor((F.col(c + "_b") + (F.col(c + "_a") - F.col(c + "_b")) * (F.col("place") - F.col("below"))) * 255), F.lit(0)).cast("int") for c in ("red", "green", "blue")}
    return j.select(*pixels.columns, *(v.alias(k) for k, v in mixed.items()))


def raster_sub(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b on common cells."""
    return a.join(b.select(*CELL, F.col("v").alias("v_b")), CELL).withColumn("v", F.col("v") - F.col("v_b")).drop("v_b")


def symmetric_range(limits: DataFrame, step: float = 10.0, symmetric: bool = True) -> DataFrame:
    """lo, hi widened so that the length of (lo, hi) is a multiple of step (one step at least); symmetric: +- the larger."""
    length = F.sqrt(F.col("lo") * F.col("lo") + F.col("hi") * F.col("hi"))
    extend = (F.greatest(F.lit(1.0), F.ceil(length / step).cast("double")) * step - length) / 2
    out = limits.withColumns({"lo": F.col("lo") - extend, "hi": F.col("hi") + extend})
    if not symmetric:
        return out
    most = F.greatest(F.abs("lo"), F.abs("hi"))
    return out.withColumns({"lo": -most, "hi": most})


def overview_level(rows: int, cols: int, target: int = 1024) -> int:
    """The pyramid level whose longer side is the least that is still at least target."""
    level = 0
    while max(rows, cols) >> (level + 1) >= target:
        level += 1
    return level


def minmax_overview(pixels: DataFrame, level: int, nodata: list[float]) -> DataFrame:
    """Range over every 2**level-th pixel, without the nodata values."""
    step = 1 << level
    return raster_minmax(pixels.filter((F.col("r") % step == 0) & (F.col("c") % step == 0) & ~F.col("v").isin([float(x) for x in nodata])))


# -- sampling -----------------------------------------------------------------------------------


def sample_nearest(points: DataFrame, pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """points (image_id, x, y) with the value of their cell, clamped to the image; null for a null coordinate or an unknown image."""
    placed = points.withColumn("r", get_cell_bounded(F.col("y"), rows)).withColumn("c", get_cell_bounded(F.col("x"), cols))
    return placed.join(pixels.select(*CELL, "v"), CELL, "left").drop("r", "c")


def sample_bilinear(points: DataFrame, pixels: DataFrame, keep: list[str], value: str = "v", border: bool = True, tile: int = 128) -> DataFrame:
    """keep and the bilinear value at (px, py) of image_id; border: replicate the edge, else null outside.

    Pixels meet the points as tiles with one pixel about them, so a point is sent once and finds its four cells in one
    row. A missing cell, a null coordinate or an unknown image makes the value null; the point stays, and repeated points
    give a row each. pixels have one band.
    """
    from .tiles import KEY, windows

    p, x, y = points, F.col("px"), F.col("py")
    if border:
        ends = pixels.groupBy("image_id").agg(F.max("r").alias("r_max"), F.max("c").alias("c_max"))
        p = points.join(small(ends), "image_id", "left")
        at_most = lambda v, top: F.when(v.isNotNull() & F.col(top).isNotNull(), F.least(clip(v, 0.0, 1e18), F.col(top).cast("double")))
        x, y = at_most(x, "c_max"), at_most(y, "r_max")
    tile_of = lambda v: F.when(v >= 0, F.floor(v / tile)).cast("int")
    p = p.select(*(F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)), F.col("image_id").cast("long").alias("image_id"), x.cast("double").alias("bx"), y.cast("double").alias("by"))
    p = p.select("*", tile_of(F.col("by")).alias("tile_r"), tile_of(F.col("bx")).alias("tile_c"))
    met = multiplied(p).join(windows(pixels, tile, 1), KEY, "left")
    fx, fy = F.col("bx") - F.floor("bx"), F.col("by") - F.floor("by")
    begin = lambda t: F.greatest(F.col(t) * tile - 1, F.lit(0))
    total, missing = F.lit(0.0), F.col("data").isNull()
    for dr, dc, w in ((0, 0, (1 - fx) * (1 - fy)), (0, 1, fx * (1 - fy)), (1, 0, (1 - fx) * fy), (1, 1, fx * fy)):
        r, c = F.floor("by") + dr - begin("tile_r"), F.floor("bx") + dc - begin("tile_c")
        cell = F.when((r < F.col("rows")) & (c < F.col("cols")), F.get("data", (r * F.col("cols") + c).cast("int")))
        total = total + F.when(w > 0, w * cell).otherwise(0.0)
        missing = missing | ((w > 0) & cell.isNull())
    return met.select(*(F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)), F.when(~missing, total).alias(value))


def remap(pixels: DataFrame, coordinates: DataFrame, interpolation: str = "linear") -> DataFrame:
    """image_id, r, c, v: the target raster whose cell (r, c) reads the source at (px, py)."""
    if interpolation == "linear":
        return sample_bilinear(coordinates, pixels, ["image_id", "r", "c"], border=False)
    if interpolation != "nearest":
        raise ValueError(f"unknown interpolation {interpolation}")
    asked = coordinates.select("image_id", F.col("r").alias("out_r"), F.col("c").alias("out_c"), F.floor(F.col("py") + 0.5).cast("int").alias("r"), F.floor(F.col("px") + 0.5).cast("int").alias("c"))
    return asked.join(pixels.select(*CELL, "v"), CELL, "left").select("image_id", F.col("out_r").alias("r"), F.col("out_c").alias("c"), "v")


# -- slopes -------------------------------------------------------------------------------------


def slope_of(sx: Column, sy: Column, z_scale: float = 1.0) -> Column:
    return F.atan(z_scale * F.sqrt(sx * sx + sy * sy))


def aspect_of(sx: Column, sy: Column) -> Column:
    """Radians in 0..2 pi; a quarter or three quarters turn where sx is 0."""
    a = F.atan2(sy, -sx)
    return F.when(sx != 0, F.when(a < 0, a + 2 * math.pi).otherwise(a)).when(sy >= 0, math.pi / 2).otherwise(3 * math.pi / 2)


def shade_scale(shaded: DataFrame) -> DataFrame:
    """One over the mean shade of each image."""
    return shaded.groupBy("image_id").agg(F.try_divide(F.lit(1.0), F.avg("shade")).alias("scale"))
