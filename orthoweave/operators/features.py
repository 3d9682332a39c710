"""Feature tables: descriptor normalisation, cells, masks and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _byte(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(x))).cast("int")


def root_normalize(desc: Column, scale: float = 512.0) -> Column:
    """Square root of each component's share of the sum, scaled, rounded and clipped to 0..255."""
    d = F.transform(desc, lambda x: x.cast("double"))
    return F.transform(d, lambda x: _byte(F.sqrt(x / _sum(d)) * scale))


def scale_normalize(desc: Column, scale: float = 512.0) -> Column:
    return F.transform(desc, lambda x: _byte(x.cast("double") * scale))


def merge_cell_features(features: DataFrame, cells: DataFrame) -> DataFrame:
    """Features detected per cell, moved by the origin (ox, oy) of their cell."""
    joined = features.join(cells.select("cell", "ox", "oy"), "cell")
    return joined.withColumn("x", F.col("x") + F.col("ox")).withColumn("y", F.col("y") + F.col("oy")).drop("ox", "oy")


def cell_budget(n: int, cells: int) -> int:
    """How many features one cell may keep before the whole image is cut to n."""
    return int(1.5 * n / cells)


def assign_cell(features: DataFrame, width: int, height: int, cell: int = 2048) -> DataFrame:
    """Cell row and column: an axis of `size` pixels has k = ceil(size / cell) half-open ranges [i * size / k, (i + 1) * size / k)."""

    def index(v: Column, size: int) -> Column:
        k = -(-size // cell)
        guess = F.floor(v * k / size)
        low = lambda i: F.floor(i * size / k)
        moved = F.when(v < low(guess), guess - 1).when(v >= low(guess + 1), guess + 1).otherwise(guess)
        return F.greatest(F.lit(0), F.least(F.lit(k - 1), moved)).cast("int")

    return features.withColumn("cell_r", index(F.col("y"), height)).withColumn("cell_c", index(F.col("x"), width))


def half_away(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(x).cast("long")


def filter_by_mask(features: DataFrame, mask: DataFrame) -> DataFrame:
    """Features whose rounded place is a pixel of mask (iid, r, c, v) with v not 0; places outside have none."""
    on = mask.filter("v <> 0").select(F.col("iid").alias("m_iid"), F.col("r").cast("long").alias("m_r"), F.col("c").cast("long").alias("m_c"))
    return features.join(on, (F.col("iid") == F.col("m_iid")) & (half_away(F.col("y")) == F.col("m_r")) & (half_away(F.col("x")) == F.col("m_c")), "left_semi")


def retain_best(features: DataFrame, n: int, by: str = "iid") -> DataFrame:
    """The n strongest of each image; all that tie with the last one stay."""
    w = Window.partitionBy(by).orderBy(F.desc("response"))
    return features.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= n).drop("rank")


def retain_best_gridded(features: DataFrame, n: int) -> DataFrame:
    """The strongest feature of each grid cell, ties to the smaller fid; images with at most n stay whole.

    The cell side follows from the image's feature box: 0.75 * sqrt(area / n), 5 at least. It is one per
    cell and so not capped at n.
    """
    box = features.groupBy("iid").agg(F.count(F.lit(1)).alias("n_all"), F.min("x").alias("x0"), F.min("y").alias("y0"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).cast("long").alias("area"))
    side = F.greatest(F.lit(5.0), F.sqrt(F.col("area").cast("double") / n) * 0.75)
    placed = features.join(box.withColumn("side", side), "iid")
    many = F.col("n_all") > n
    keyed = placed.withColumn("cell_r", F.when(many, F.floor((F.col("y") - F.col("y0")) / F.col("side"))).otherwise(F.col("fid")))
    keyed = keyed.withColumn("cell_c", F.when(many, F.floor((F.col("x") - F.col("x0")) / F.col("side"))).otherwise(-1))
    best = F.row_number().over(Window.partitionBy("iid", "cell_r", "cell_c").orderBy(F.desc("response"), "fid"))
    return keyed.withColumn("rank", best).filter("rank = 1").select(*features.columns)


def attach_ends(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Coordinates of both ends: x1, y1, x2, y2."""
    end = lambda i, f, x, y: features.select(F.col("iid").alias(i), F.col("fid").alias(f), F.col("x").alias(x), F.col("y").alias(y))
    return matches.join(end("iid_i", "fid_i", "x1", "y1"), ["iid_i", "fid_i"]).join(end("iid_j", "fid_j", "x2", "y2"), ["iid_j", "fid_j"])


def attach_xy(observations: DataFrame, features: DataFrame) -> DataFrame:
    return observations.join(features.select("iid", "fid", "x", "y"), ["iid", "fid"])


def image_pairs(images: DataFrame) -> DataFrame:
    """Unordered pairs of distinct images."""
    i = images.select("iid").distinct()
    return i.select(F.col("iid").alias("iid_i")).join(i.select(F.col("iid").alias("iid_j")), F.col("iid_i") < F.col("iid_j"))
