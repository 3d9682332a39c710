"""Registry of queries: one entry an operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import text, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Views and tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from ..session import table
        from ..views import VIEWS

        return view(self.spark, self.sf_dir, name) if name in VIEWS else table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register fn(inputs) -> DataFrame under name; sql may name views in braces."""

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            ORACLES[name] = text(sql)
        return fn

    return put
