"""Tiles: blocks of pixels as arrays, stencils over tiles with borders taken from their neighbours, and tiles stored as Parquet.

A tile sends strips of its border to the up to eight tiles around it; tiles and strips meet by the key of the tile.
A stencil then runs on whole arrays, so what is shuffled is the pixels once, into tiles, and the strips.
Tables: pixels(image_id, r, c[, band], v); tiles(image_id, level, tile_r, tile_c, band, data), row-major, null where there
is no pixel.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cameras import small

KEY = ["image_id", "tile_r", "tile_c"]
_CELLS = "array<struct<at:int,v:double>>"
#: pixels of the tiles that a Python worker makes at a time
_PIXELS = 1 << 20


def _scattered(cells: pa.ListScalar, size: int) -> np.ndarray:
    """size values, NaN where there is no pixel, from a list of (at, v)."""
    out = np.full(size, np.nan)
    inner = cells.values
    v = inner.field("v").to_numpy(zero_copy_only=False)
    known = ~np.isnan(v)
    out[inner.field("at").to_numpy(zero_copy_only=False)[known]] = v[known]
    return out


# -- pixels to tiles and back -------------------------------------------------------------------


def to_tiles(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """image_id, level, tile_r, tile_c, band, data array<float>: half-open tiles, row-major; absent pixels and NaN are null."""
    placed = pixels.withColumn("level", F.lit(0)) if "level" not in pixels.columns else pixels
    at = F.pmod("r", F.lit(tile)) * tile + F.pmod("c", F.lit(tile))
    key = ["image_id", "level", "tile_r", "tile_c", "band"]
    cells = placed.select(F.col("image_id").cast("long").alias("image_id"), F.col("level").cast("int").alias("level"), F.floor(F.col("r") / tile).cast("int").alias("tile_r"), F.floor(F.col("c") / tile).cast("int").alias("tile_c"), F.col("band").cast("int").alias("band"), F.struct(at.cast("int").alias("at"), F.col("v").cast("double").alias("v")).alias("cell"))
    listed = cells.groupBy(*key).agg(F.collect_list("cell").alias("cells"))
    few = max(1, _PIXELS // (tile * tile))

    def dense(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, few):  # a few tiles at a time, however many a batch holds
                part = batch.slice(at, few)
                data = np.concatenate([_scattered(x, tile * tile).astype(np.float32) for x in part.column(5)])
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * (tile * tile)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.ListArray.from_arrays(pa.array(ends), pa.array(data, from_pandas=True))], names=[*key, "data"])

    return listed.mapInArrow(dense, "image_id long, level int, tile_r int, tile_c int, band int, data array<float>")


def to_pixels(tiles: DataFrame, tile: int = 256) -> DataFrame:
    """Pixels of tiles; null cells are left out."""
    return tiles.select("image_id", "level", "band", "tile_r", "tile_c", F.posexplode("data").alias("at", "v")).filter("v is not null").select(
        "image_id", "level", (F.col("tile_r") * tile + F.floor(F.col("at") / tile)).cast("int").alias("r"), (F.col("tile_c") * tile + F.col("at") % tile).cast("int").alias("c"), "band", F.col("v").cast("double").alias("v")
    )


# -- windows ------------------------------------------------------------------------------------


def windows(pixels: DataFrame, tile: int = 256, halo: int = 1) -> DataFrame:
    """image_id, tile_r, tile_c, rows, cols, data array<double>: tiles with the pixels up to `halo` about them, row-major.

    A window begins `halo` before its tile, or at the image's first row and column, and ends with its last pixel; null where
    there is no pixel. Rows and columns are numbered from 0.
    """
    width = tile + 2 * halo
    touched = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int")))
    place = lambda c, t: (F.col(c) - F.greatest(F.col(t) * tile - halo, F.lit(0))).cast("int")
    inside = pixels.filter("r >= 0 and c >= 0").select(F.col("image_id").cast("long").alias("image_id"), "r", "c", F.col("v").cast("double").alias("v"))
    keyed = inside.select("*", touched("r").alias("tile_r")).select("*", touched("c").alias("tile_c"))
    cells = keyed.select(*KEY, F.struct((place("r", "tile_r") * width + place("c", "tile_c")).alias("at"), "v").alias("cell"))
    listed = cells.groupBy(*KEY).agg(F.collect_list("cell").alias("cells"))

    def dense(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one at a time, as arrays
                inner = batch.column(3)[row].values
                at, v = inner.field("at").to_numpy(zero_copy_only=False), inner.field("v")
                r, c = at // width, at % width
                rows, cols = int(r.max()) + 1, int(c.max()) + 1
                data, absent = np.zeros(rows * cols), np.ones(rows * cols, dtype=bool)
                data[r * cols + c] = v.fill_null(0.0).to_numpy(zero_copy_only=False)
                absent[r * cols + c] = v.is_null().to_numpy(zero_copy_only=False)
                one = pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data, mask=absent))
                yield pa.RecordBatch.from_arrays([*(k.slice(row, 1) for k in batch.columns[:3]), pa.array([rows], pa.int32()), pa.array([cols], pa.int32()), one], names=[*KEY, "rows", "cols", "data"])

    return listed.mapInArrow(dense, "image_id long, tile_r int, tile_c int, rows int, cols int, data array<double>")


class Window:
    """The pixels of one row of windows(); covers(r0, c0, r1, c1) is what it would hold if the image had it all."""

    def __init__(self, tile_r: int, tile_c: int, rows: int, cols: int, data: pa.Array, tile: int, halo: int):
        self.r0, self.c0 = max(tile_r * tile - halo, 0), max(tile_c * tile - halo, 0)
        self.r1, self.c1 = (tile_r + 1) * tile + halo, (tile_c + 1) * tile + halo
        self.rows, self.cols = rows, cols
        self.data = data.fill_null(0.0).to_numpy(zero_copy_only=False)
        self.present = data.is_valid().to_numpy(zero_copy_only=False)

    def bilinear(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values at (px, py); are all pixels with weight there; and would the window hold them, or does no image."""
        c0, r0 = np.floor(px), np.floor(py)
        fx, fy = px - c0, py - r0
        value, known, covered = np.zeros(px.shape), np.isfinite(px) & np.isfinite(py), np.ones(px.shape, dtype=bool)
        c0, r0 = (np.where(known, np.clip(x, -1, 1 << 40), -1).astype(np.int64) for x in (c0, r0))
        for dr, dc, w in ((0, 0, (1 - fx) * (1 - fy)), (0, 1, fx * (1 - fy)), (1, 0, (1 - fx) * fy), (1, 1, fx * fy)):
            r, c, needed = r0 + dr, c0 + dc, w > 0
            covered &= ~needed | (r < 0) | (c < 0) | ((r >= self.r0) & (r < self.r1) & (c >= self.c0) & (c < self.c1))
            r, c = r - self.r0, c - self.c0
            inside = (r >= 0) & (c >= 0) & (r < self.rows) & (c < self.cols)
            at = np.where(inside, r * self.cols + c, 0)
            known &= ~needed | (inside & self.present[at])
            value += np.where(needed, w, 0.0) * self.data[at]
        return value, known, covered


def beside_windows(asked: DataFrame, tiles: DataFrame, make: Callable[[pa.RecordBatch, Window], pa.RecordBatch], schema, tile: int, halo: int) -> DataFrame:
    """What make(rows, window) gives for the rows of asked(image_id, tile_r, tile_c, ...) beside their row of windows().

    Rows and windows come in one stream, ordered by tile, so a window is sent once and not with every row, and a task holds
    one window and one batch of rows however many ask for it. Rows without a window give nothing. make gets the columns
    after the key.
    """
    from ..session import spread_rows

    names = [c for c in asked.columns if c not in KEY]
    key = [F.col("image_id").cast("long").alias("image_id"), F.col("tile_r").cast("int").alias("tile_r"), F.col("tile_c").cast("int").alias("tile_c")]
    known = asked.filter(" and ".join(f"{k} is not null" for k in KEY))
    kinds = {"rows": "int", "cols": "int", "data": "array<double>"}
    a = known.select(*key, F.lit(1).alias("side"), *(F.lit(None).cast(t).alias("w_" + c) for c, t in kinds.items()), *names)
    w = tiles.select(*key, F.lit(0).alias("side"), *(F.col(c).alias("w_" + c) for c in kinds), *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in names))
    dealt = spread_rows(w.unionByName(a), *KEY).sortWithinPartitions(*KEY, "side")

    def run(batches):
        now, window = None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            side = batch.column(3).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(keys, axis=1) != 0).any(axis=0))))[: batch.num_rows]
            rows, made = pa.RecordBatch.from_arrays(batch.columns[7:], names=names), []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if now != (own := tuple(keys[:, a].tolist())):
                    now, window = own, None
                if side[a] == 0:
                    window = Window(own[1], own[2], batch.column(4)[a].as_py(), batch.column(5)[a].as_py(), batch.column(6)[a].values, tile, halo)
                    a += 1
                if a < b and window is not None:
                    made.append(make(rows.slice(a, b - a), window))
            yield from pa.Table.from_batches(made).combine_chunks().to_batches() if made else ()

    return dealt.mapInArrow(run, schema)


# -- stencils -----------------------------------------------------------------------------------


def _sized(pixels: DataFrame, rows: int | DataFrame, cols: int | None) -> DataFrame:
    if isinstance(rows, DataFrame):
        return pixels.join(small(rows.select("image_id", F.col("rows").cast("int").alias("n_rows"), F.col("cols").cast("int").alias("n_cols"))), "image_id")
    return pixels.withColumns({"n_rows": F.lit(rows), "n_cols": F.lit(cols)})


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Index mirrored at the border without repeating the edge."""
    return np.clip(np.where(i < 0, -i, np.where(i > n - 1, 2 * (n - 1) - i, i)), 0, n - 1)


def stencil(pixels: DataFrame, rows: int | DataFrame, cols: int | None, reach: int, apply: Callable, tile: int = 256, mirror: bool = True) -> DataFrame:
    """image_id, r, c, v: what `apply` makes of every tile and a border of `reach` pixels about it.

    rows, cols: size of all images, or a table (image_id, rows, cols). apply(window, row, col, rows, cols) gets the pixels
    of a tile with its border (NaN: absent), the place of the tile's first pixel in the image and the size of
    the image, and returns r, c and v as arrays; v of NaN is left out. mirror: beyond the edge of the image
    the border is mirrored without repeating the edge, else absent. Pixels outside of the image, or with a null
    place, are left out. A tile holds at most tile^2 pixels, whatever the image.
    """
    if tile < 2 * reach:
        raise ValueError("a tile must be twice as wide as the reach of the stencil")
    inside = _sized(pixels.select(F.col("image_id").cast("long").alias("image_id"), "r", "c", F.col("v").cast("double").alias("v")), rows, cols).filter((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("n_rows")) & (F.col("c") < F.col("n_cols")))
    at = (F.col("r") % tile) * tile + F.col("c") % tile
    keyed = inside.select("image_id", F.floor(F.col("r") / tile).cast("int").alias("tile_r"), F.floor(F.col("c") / tile).cast("int").alias("tile_c"), "n_rows", "n_cols", F.struct(at.cast("int").alias("at"), "v").alias("cell"))
    tiles = keyed.groupBy(*KEY).agg(F.first("n_rows").cast("int").alias("n_rows"), F.first("n_cols").cast("int").alias("n_cols"), F.collect_list("cell").alias("cells"))
    shape = lambda tr, tc, n, m: (min(tile, n - tr * tile), min(tile, m - tc * tile))

    def strips(batches):
        for batch in batches:
            out = []
            for image, tr, tc, n, m, cells in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                h, w = shape(tr, tc, n, m)
                a = _scattered(cells, tile * tile).reshape(tile, tile)[:h, :w]
                side = {-1: slice(0, reach), 0: slice(None), 1: slice(-reach, None)}
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        r, c = tr + dr, tc + dc
                        if (dr or dc) and 0 <= r and 0 <= c and r * tile < n and c * tile < m:
                            strip = a[side[dr], side[dc]]
                            out.append((image, r, c, -dr, -dc, strip.shape[0], strip.ravel()))
            if out:
                fields = list(zip(*out, strict=True))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in fields[6]]))).astype(np.int32)
                kinds = (pa.int64(), *[pa.int32()] * 5)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(fields[:6], kinds, strict=True)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(fields[6])))], names=["s_image", "s_r", "s_c", "dr", "dc", "height", "data"])

    sent = tiles.mapInArrow(strips, "s_image long, s_r int, s_c int, dr int, dc int, height int, data array<double>")
    schema = pa.schema([("image_id", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("v", pa.float64())])

    def run(image: int, tr: int, tc: int, n: int, m: int, cells: pa.ListScalar, border: pa.ListScalar) -> tuple:
        h, w = shape(tr, tc, n, m)
        window = np.full((h + 2 * reach, w + 2 * reach), np.nan)
        window[reach : reach + h, reach : reach + w] = _scattered(cells, tile * tile).reshape(tile, tile)[:h, :w]
        for dr, dc, height, data in zip(*(border.values.field(k).to_pylist() for k in ("dr", "dc", "height")), border.values.field("data"), strict=True) if border.is_valid else ():
            strip = data.values.to_numpy(zero_copy_only=False).reshape(height, -1)
            # a neighbour before this tile ends at its border; one behind it starts there
            r = reach - strip.shape[0] if dr < 0 else reach if dr == 0 else reach + h
            c = reach - strip.shape[1] if dc < 0 else reach if dc == 0 else reach + w
            window[r : r + strip.shape[0], c : c + strip.shape[1]] = strip
        if mirror:
            r = _mirrored(np.arange(tr * tile - reach, tr * tile + h + reach), n) - tr * tile + reach
            c = _mirrored(np.arange(tc * tile - reach, tc * tile + w + reach), m) - tc * tile + reach
            window = window[np.clip(r, 0, len(r) - 1)][:, np.clip(c, 0, len(c) - 1)]
        r, c, v = apply(window, tr * tile, tc * tile, n, m)
        known = ~np.isnan(v)
        return np.full(int(known.sum()), image), r[known].astype(np.int32), c[known].astype(np.int32), v[known]

    few = max(1, _PIXELS // (tile * tile))

    def every(batches):
        for batch in batches:
            # tiles of a batch follow one another, since a group of its own costs more than the work on a small tile
            for at in range(0, batch.num_rows, few):
                part = batch.slice(at, few)
                made = [run(*x) for x in zip(*(part.column(k).to_pylist() for k in range(5)), part.column(5), part.column(6), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)

    borders = sent.groupBy(*(F.col(s).alias(k) for s, k in zip(("s_image", "s_r", "s_c"), KEY, strict=True))).agg(F.collect_list(F.struct("dr", "dc", "height", "data")).alias("strips"))
    return tiles.join(borders, KEY, "left").select(*KEY, "n_rows", "n_cols", "cells", "strips").mapInArrow(every, "image_id long, r int, c int, v double")


def _places(window: np.ndarray, reach: int, row: int, col: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a tile's pixels, and the tile without its border."""
    centre = window[reach : window.shape[0] - reach, reach : window.shape[1] - reach]
    r, c = np.mgrid[row : row + centre.shape[0], col : col + centre.shape[1]]
    return r, c, centre


def _weighted(window: np.ndarray, weights: list[list[float]]) -> np.ndarray:
    """Sum of the neighbours of each pixel by weight; absent ones add nothing."""
    k = len(weights)
    filled = np.nan_to_num(window)
    h, w = window.shape[0] - k + 1, window.shape[1] - k + 1
    out = np.zeros((h, w))
    for i in range(k):
        for j in range(k):
            if weights[i][j]:
                out += weights[i][j] * filled[i : i + h, j : j + w]
    return out


_SOBEL = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]


def sobel(pixels: DataFrame, rows: int | DataFrame, cols: int | None = None, cell: float = 1.0, tile: int = 256) -> DataFrame:
    """image_id, r, c, sx, sy: 3 x 3 gradients (an eighth of the Sobel sums, per cell size) at every pixel, mirrored border."""

    def gradients(window, row, col, n, m):
        r, c, centre = _places(window, 1, row, col)
        sx, sy = _weighted(window, _SOBEL) / (8 * cell), _weighted(window, [list(x) for x in zip(*_SOBEL, strict=True)]) / (8 * cell)
        here = ~np.isnan(centre)
        # both come out as rows: columns beyond the image hold the second
        return np.concatenate((r[here], r[here])), np.concatenate((c[here], c[here] + m)), np.concatenate((sx[here], sy[here]))

    both = _sized(stencil(pixels, rows, cols, 1, gradients, tile), rows, cols)
    second = F.col("c") >= F.col("n_cols")
    return both.groupBy("image_id", "r", F.when(second, F.col("c") - F.col("n_cols")).otherwise(F.col("c")).alias("c")).agg(F.max(F.when(~second, F.col("v"))).alias("sx"), F.max(F.when(second, F.col("v"))).alias("sy"))


def hillshade(pixels: DataFrame, rows: int | DataFrame, cols: int | None = None, cell: float = 1.0, z_scale: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, tile: int = 256) -> DataFrame:
    """image_id, r, c, shade: illumination clipped to 0..1 from 3 x 3 Sobel gradients, mirrored border; one row a pixel."""
    turned, zenith = math.radians((360.0 - azimuth + 90.0) % 360.0), math.radians(90.0 - altitude)

    def shade(window, row, col, n, m):
        r, c, centre = _places(window, 1, row, col)
        sx, sy = _weighted(window, _SOBEL) / (8 * cell), _weighted(window, [list(x) for x in zip(*_SOBEL, strict=True)]) / (8 * cell)
        slope = np.arctan(z_scale * np.sqrt(sx * sx + sy * sy))
        a = np.arctan2(sy, -sx)
        aspect = np.where(sx != 0, np.where(a < 0, a + 2 * math.pi, a), np.where(sy >= 0, math.pi / 2, 3 * math.pi / 2))
        v = np.clip(math.cos(zenith) * np.cos(slope) + math.sin(zenith) * np.sin(slope) * np.cos(turned - aspect), 0.0, 1.0)
        return r.ravel(), c.ravel(), np.where(np.isnan(centre), np.nan, v).ravel()

    return stencil(pixels, rows, cols, 1, shade, tile).withColumnRenamed("v", "shade")


def erode(mask: DataFrame, rows: int | DataFrame, cols: int | None = None, tile: int = 256) -> DataFrame:
    """3 x 3 binary erosion of v (0 or 1); outside counts as 1."""

    def least(window, row, col, n, m):
        r, c, centre = _places(window, 1, row, col)
        h, w = centre.shape
        low = np.fmin.reduce([window[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        return r.ravel(), c.ravel(), np.where(np.isnan(centre), np.nan, low).ravel()

    return stencil(mask, rows, cols, 1, least, tile, mirror=False).withColumn("v", F.col("v").cast("int"))


_GAUSS = (1, 4, 6, 4, 1)


def halved(pixels: DataFrame, rows: int | DataFrame, cols: int | None = None, kernel: str = "gauss", tile: int = 256) -> DataFrame:
    """The next pyramid level: even pixels after a 5-tap Gaussian (mirrored border), or as they are (nearest)."""
    if kernel == "nearest":
        even = pixels.filter((F.col("r") % 2 == 0) & (F.col("c") % 2 == 0))
        return even.select("image_id", F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c"), "v")
    weights = [[a * b / 256.0 for b in _GAUSS] for a in _GAUSS]

    def smooth(window, row, col, n, m):
        r, c, centre = _places(window, 2, row, col)
        even = (r % 2 == 0) & (c % 2 == 0)
        v = np.where(np.isnan(centre), np.nan, _weighted(window, weights))
        return r[even] // 2, c[even] // 2, v[even]

    return stencil(pixels, rows, cols, 2, smooth, tile)


def build_pyramid(pixels: DataFrame, rows: int, cols: int, smallest: int = 256, kernel: str = "gauss", tile: int = 256) -> DataFrame:
    """image_id, level, r, c, v: level 0 always, then halves until both sides are at most `smallest`."""
    from ..session import stage

    level, current = 0, pixels.select("image_id", "r", "c", "v")
    out = current.withColumn("level", F.lit(0))
    while max(rows, cols) > smallest:
        current = stage(halved(current, rows, cols, kernel, tile), "pyramid-level")
        rows, cols, level = -(-rows // 2), -(-cols // 2), level + 1
        out = out.unionByName(current.withColumn("level", F.lit(level)))
    return out


def smooth_resize(pixels: DataFrame, rows: int, cols: int, out_rows: int, out_cols: int, tile: int = 256) -> DataFrame:
    """Box filter of round(scale) pixels about the nearest pixel of each target centre; windows are cut at the image edge."""
    kr, kc = max(1, round(rows / out_rows)), max(1, round(cols / out_cols))
    reach = max(kr, kc)
    tile = max(tile, 2 * reach)

    def box(window, row, col, n, m):
        h, w = window.shape[0] - 2 * reach, window.shape[1] - 2 * reach

        def targets(first, size, full, out, k):
            place = np.arange(out)
            centre = np.floor((place + 0.5) * full / out).astype(int)
            mine = (centre >= first) & (centre < first + size)
            begin = centre[mine] - k // 2
            lift = reach - first
            return place[mine], np.maximum(begin, 0) + lift, np.minimum(begin + k, full) + lift

        i, r0, r1 = targets(row, h, n, out_rows, kr)
        j, c0, c1 = targets(col, w, m, out_cols, kc)
        known = ~np.isnan(window)
        # sums over rectangles from running sums in both directions
        sums = [np.pad(np.cumsum(np.cumsum(x, axis=0), axis=1), ((1, 0), (1, 0))) for x in (np.where(known, window, 0.0), known.astype(float))]
        total, count = (s[np.ix_(r1, c1)] - s[np.ix_(r0, c1)] - s[np.ix_(r1, c0)] + s[np.ix_(r0, c0)] for s in sums)
        v = np.where(count > 0, total / np.maximum(count, 1), np.nan)
        r, c = np.meshgrid(i, j, indexing="ij")
        return r.ravel(), c.ravel(), v.ravel()

    if "band" not in pixels.columns:
        return stencil(pixels, rows, cols, reach, box, tile, mirror=False)
    # bands are images of their own
    bands = pixels.withColumn("image_id", F.struct("image_id", "band"))
    numbered = bands.select("image_id").distinct().withColumn("own", F.xxhash64("image_id"))
    placed = pixels.withColumn("own", F.xxhash64(F.struct("image_id", "band")))
    made = stencil(placed.select(F.col("own").alias("image_id"), "r", "c", "v"), rows, cols, reach, box, tile, mirror=False)
    return made.withColumnRenamed("image_id", "own").join(small(numbered), "own").select("image_id.image_id", "image_id.band", "r", "c", "v")


# -- stored tiles -------------------------------------------------------------------------------


def write_tiles(pixels: DataFrame, headers: DataFrame, path: str, tile: int = 256, levels: int = 1, stripes: int = 16) -> None:
    """Stores pixels(image_id, r, c, band, v) as Parquet tiles of `levels` levels, each half the one before (nearest).

    The folder is partitioned by level and by stripe, a hash of the image, so a read of some images at one
    level opens only those files, and a patch rewrites only the stripes that it touches. headers(image_id, rows,
    cols) is stored beside the tiles, with the tile size.
    """
    current, first = pixels.select("image_id", "r", "c", "band", "v"), True
    for level in range(levels):
        tiles = to_tiles(current.withColumn("level", F.lit(level)), tile).withColumn("stripe", _stripe(stripes))
        tiles.repartition("stripe", *KEY).write.mode("overwrite" if first else "append").partitionBy("level", "stripe").parquet(f"{path}/tiles")
        current, first = _every_second(current), False
    meta = headers.select("image_id", "rows", "cols").withColumns({"tile": F.lit(tile), "levels": F.lit(levels), "stripes": F.lit(stripes)})
    meta.write.mode("overwrite").parquet(f"{path}/headers")


def _stripe(stripes: int | Column) -> Column:
    return F.pmod(F.xxhash64("image_id"), stripes if isinstance(stripes, Column) else F.lit(stripes)).cast("int")


def _every_second(pixels: DataFrame) -> DataFrame:
    even = pixels.filter((F.col("r") % 2 == 0) & (F.col("c") % 2 == 0))
    return even.withColumns({"r": F.floor(F.col("r") / 2).cast("int"), "c": F.floor(F.col("c") / 2).cast("int")})


def stored_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers")


def read_patches(spark: SparkSession, path: str, rois: DataFrame) -> DataFrame:
    """roi_id, level, r, c, band, v: each region of stored tiles at its target size, by the nearest pixel.

    rois: roi_id, image_id, r0, c0, rows, cols, out_rows, out_cols, in pixels of level 0. A region is read at the
    highest level that still has a pixel for each target pixel, from the tiles that cover it: regions ask for
    tile keys, and the scan is pruned to the levels and stripes asked for. A region that is not inside its
    image gives nothing; target pixels whose pixel is absent are left out.
    """
    meta = stored_headers(spark, path).select("image_id", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), "tile", "levels", "stripes")
    inside = rois.join(small(meta), "image_id").filter("r0 >= 0 and c0 >= 0 and rows > 0 and cols > 0 and out_rows > 0 and out_cols > 0 and r0 + rows <= n_rows and c0 + cols <= n_cols")
    scale = F.least(F.col("rows") / F.col("out_rows"), F.col("cols") / F.col("out_cols"))
    level = F.greatest(F.lit(0), F.least(F.col("levels") - 1, F.floor(F.log2(scale) + 1e-9))).cast("int")
    asked = inside.withColumn("level", level).withColumn("stripe", _stripe(F.col("stripes")))
    grid = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("out_rows") - 1)).alias("i"))
    # a line of target pixels per row; its columns come out of the tile by index
    step = F.pow(F.lit(2.0), F.col("level"))
    at = lambda origin, k, n, out: F.floor(F.least(F.col(origin) + F.col(n) - 1, F.col(origin) + F.floor((F.col(k) + 0.5) * F.col(n) / F.col(out))) / step).cast("int")
    lines = grid.withColumn("pr", at("r0", "i", "rows", "out_rows"))
    wanted = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("out_cols") - 1)).alias("j")).withColumn("pc", at("c0", "j", "cols", "out_cols"))
    tile = F.col("tile")
    keyed = wanted.groupBy("level", "stripe", "image_id", F.floor(F.col("pr") / tile).cast("int").alias("tile_r"), F.floor(F.col("pc") / tile).cast("int").alias("tile_c"), "roi_id").agg(
        F.collect_list(F.struct("i", "j", ((F.col("pr") % tile) * tile + F.col("pc") % tile).cast("int").alias("at"))).alias("cells")
    )
    stored = spark.read.parquet(f"{path}/tiles")
    met = stored.join(keyed, ["level", "stripe", *KEY])
    out = met.select("roi_id", "level", "band", "data", F.explode("cells").alias("x")).select("roi_id", "level", F.col("x.i").alias("r"), F.col("x.j").alias("c"), "band", F.get("data", F.col("x.at")).cast("double").alias("v"))
    return out.filter("v is not null")


def write_patches(spark: SparkSession, path: str, patch: DataFrame, rois: DataFrame) -> None:
    """Writes patches(roi_id, r, c, band, v) into the regions (roi_id, image_id, r0, c0, rows, cols) of stored tiles, at all levels.

    A patch must fill its region (each band that it has: rows * cols pixels from (0, 0)), and a region must lie inside
    its image; else nothing is written and ValueError is raised. Only the stripes of touched images are rewritten.
    """
    meta = stored_headers(spark, path)
    one = meta.select("tile", "levels", "stripes").first()
    if one is None:
        raise ValueError("no image is stored")
    placed = rois.join(small(meta.select("image_id", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"))), "image_id", "left")
    outside = placed.filter("n_rows is null or r0 < 0 or c0 < 0 or rows < 1 or cols < 1 or r0 + rows > n_rows or c0 + cols > n_cols")
    if not outside.isEmpty():
        raise ValueError("a region is not inside its image")
    joined = patch.join(small(placed), "roi_id")
    shape = joined.groupBy("roi_id", "band").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("r", "c").alias("cells"), F.first(F.col("rows") * F.col("cols")).alias("all"), F.count_if(F.expr("r < 0 or c < 0 or r >= rows or c >= cols")).alias("off"))
    if not shape.filter("n <> all or cells <> all or off > 0").isEmpty() or patch.select("roi_id").distinct().count() != rois.select("roi_id").distinct().count():
        raise ValueError("a patch does not have the shape of its region")
    new = joined.select("image_id", (F.col("r0") + F.col("r")).alias("r"), (F.col("c0") + F.col("c")).alias("c"), "band", F.col("v").alias("new_v"))
    touched = small(rois.select("image_id").distinct().withColumn("stripe", _stripe(one.stripes)).select("stripe").distinct())
    key = ["image_id", "level", "tile_r", "tile_c", "band"]
    from ..session import stage

    for level in range(one.levels):
        step = 1 << level
        here = new.filter((F.col("r") % step == 0) & (F.col("c") % step == 0)).withColumns({"r": F.floor(F.col("r") / step).cast("int"), "c": F.floor(F.col("c") / step).cast("int")})
        stored = spark.read.parquet(f"{path}/tiles").filter(F.col("level") == level).join(touched, "stripe", "left_semi")
        cells = here.groupBy("image_id", F.lit(level).alias("level"), F.floor(F.col("r") / one.tile).cast("int").alias("tile_r"), F.floor(F.col("c") / one.tile).cast("int").alias("tile_c"), F.col("band").cast("int").alias("band")).agg(
            F.collect_list(F.struct(((F.col("r") % one.tile) * one.tile + F.col("c") % one.tile).cast("int").alias("at"), F.col("new_v").cast("float").alias("v"))).alias("cells")
        )
        changed = stored.drop("stripe").join(cells, key, "full").withColumn("stripe", _stripe(one.stripes)).select(*key, "stripe", "data", "cells")  # tiles that were empty appear

        def put(batches):
            for batch in batches:
                # one tile at a time, as arrays: a batch may hold hundreds of tiles
                for row in range(batch.num_rows):
                    data, cells = batch.column(6)[row], batch.column(7)[row]
                    d = np.array(data.values.to_numpy(zero_copy_only=False), dtype=np.float32) if data.is_valid else np.full(one.tile * one.tile, np.nan, dtype=np.float32)
                    if cells.is_valid:
                        inner = cells.values
                        d[inner.field("at").to_numpy(zero_copy_only=False)] = inner.field("v").to_numpy(zero_copy_only=False)
                    put_back = pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), pa.array(d, from_pandas=True))
                    yield pa.RecordBatch.from_arrays([*(c.slice(row, 1) for c in batch.columns[:6]), put_back], names=[*key, "stripe", "data"])

        done = stage(changed.mapInArrow(put, "image_id long, level int, tile_r int, tile_c int, band int, stripe int, data array<float>"), "tiles-patched")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "stripe").parquet(f"{path}/tiles")
