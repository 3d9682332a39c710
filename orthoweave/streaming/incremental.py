"""Incremental batch work: skip what is done, keep what was computed, recompute a rectangle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of inputs whose key is not in done; a null key is always pending. Also usable in foreachBatch."""
    return inputs.join(done.select(*key).distinct(), key, "left_anti")


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; computed and written there first where it does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    compute().write.parquet(path)
    return spark.read.parquet(path)


def recompute_region(old: DataFrame, changed: DataFrame, compute: Callable[[DataFrame], DataFrame], inputs: DataFrame, halo: int, key: list[str] = ["image_id", "r", "c"]) -> DataFrame:
    """old with the cells of `changed` (and a halo) computed anew from inputs.

    compute sees the changed cells with twice the halo around them, and its results are kept where
    their own neighbourhood was complete.
    """
    image, r, c = key
    spread = lambda n: changed.select(image, F.explode(F.sequence(F.col(r) - n, F.col(r) + n)).alias(r), c).select(image, r, F.explode(F.sequence(F.col(c) - n, F.col(c) + n)).alias(c)).distinct()
    target = spread(halo)
    fresh = compute(inputs.join(spread(2 * halo), key, "left_semi")).join(target, key, "left_semi")
    return old.join(target, key, "left_anti").unionByName(fresh)


def recompute_range(old: DataFrame, old_range: DataFrame, changed: DataFrame, inputs: DataFrame, color: Callable[[DataFrame], DataFrame], widen: Callable[[DataFrame], DataFrame], key: list[str] = ["image_id", "r", "c"]) -> tuple[DataFrame, DataFrame]:
    """The coloured cells of all images after a change, and the range of each image.

    old: coloured cells; old_range(image_id, lo, hi); changed: the cells that changed; inputs(image_id, r, c, v): all values as
    they are now. An image whose changed values stay within its range is coloured anew at the changed cells
    only; where they leave it (after widen(), which makes a range of the least and greatest values) the range
    grows and the whole image is computed again. Which it is is decided by one aggregate an image inside
    the plan. color(cells with lo and hi) gives the coloured cells. An image without an old range is new: all of it
    is computed. Null values do not move the range.
    """
    fresh = inputs.join(changed.select(*key).distinct(), key, "left_semi")
    seen = fresh.groupBy(key[0]).agg(F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
    # widen() sees the least and greatest of the old range and the new values
    both = seen.join(old_range, key[0], "full").select(key[0], F.least("new_lo", "lo").alias("lo"), F.greatest("new_hi", "hi").alias("hi"), F.col("lo").alias("was_lo"), F.col("hi").alias("was_hi"), F.coalesce(F.col("new_lo") < F.col("lo"), F.lit(False)).alias("below"), F.coalesce(F.col("new_hi") > F.col("hi"), F.lit(False)).alias("over"))
    grown = both.withColumn("grows", F.col("below") | F.col("over") | F.col("was_lo").isNull())
    ranges = widen(grown.filter("grows").select(key[0], "lo", "hi")).withColumn("grows", F.lit(True)).unionByName(grown.filter("not grows").select(key[0], F.col("was_lo").alias("lo"), F.col("was_hi").alias("hi"), F.lit(False).alias("grows")))
    whole = inputs.join(ranges.filter("grows").select(key[0], "lo", "hi"), key[0])
    part = fresh.join(ranges.filter("not grows").select(key[0], "lo", "hi"), key[0])
    kept = old.join(ranges.filter("grows").select(key[0]), key[0], "left_anti").join(changed.select(*key), key, "left_anti")
    return kept.unionByName(color(whole.unionByName(part))), ranges.select(key[0], "lo", "hi")
