"""Session and staging helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; the path is opened by Spark alone, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see.

    Where the setting is absent a fresh temporary folder is used and remembered in the session, on one
    machine only; on a cluster that is an error, since executors would write where no other can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("orthoweave.stage.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("orthoweave.stage.dir", folder)
    return folder.rstrip("/")


#: paths of the tables staged since the innermost staging() of this thread began
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging():
    """The paths of the tables that this thread stages inside the block, in order; other queries of the driver have lists of their own."""
    paths: list[str] = []
    outer = _staged.set(paths)
    try:
        yield paths
    finally:
        _staged.reset(outer)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows re-reads the table when an executor is lost, and Python work
    upstream runs once however often the result is used. Row groups are small, so that a task that
    writes long texts holds little.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    if (paths := _staged.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df, an upper bound for scans and filters of files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def multiplied(df: DataFrame) -> DataFrame:
    """df, whose rows come out of a generator, marked to meet other tables by sort and merge.

    Catalyst's estimate of the size of a generator's rows is that of its input, so a large table would pass for a
    small one and be sent whole through the driver. A broadcast hint on the other table still holds.
    """
    return df.hint("merge")


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as a shuffle has, before work that multiplies its rows or is slow a row.

    The number is given, so that adaptive execution, which sees only how small the rows are, does not put them together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
