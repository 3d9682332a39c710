"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """mean, sample variance, sample standard deviation and root mean square; nulls take no part."""
    c = F.col(col)
    return df.groupBy(*by).agg(F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.stddev_samp(c).alias("stddev"), F.sqrt(F.avg(c * c)).alias("rmse"))


def median(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.median(col).alias("median"))


def percentile_nearest(df: DataFrame, col: str, p: float, by: list[str]) -> DataFrame:
    """The value at rank round(p / 100 * (n - 1)), half away from zero; no interpolation.

    Values are counted first, so that equal values are one row of the window.
    """
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(*by)
    ranked = counted.select("*", F.sum("n").over(within.orderBy(col)).alias("upto"), F.sum("n").over(within).alias("total"))
    return ranked.filter(F.col("upto") > F.round(p / 100 * (F.col("total") - 1))).groupBy(*by).agg(F.min(col).alias("percentile"))


def any_less_than(df: DataFrame, col: str, threshold: float, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.bool_or(F.col(col) < threshold).alias("any_less"))


def any_greater_than(df: DataFrame, col: str, threshold: float, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.bool_or(F.col(col) > threshold).alias("any_greater"))
