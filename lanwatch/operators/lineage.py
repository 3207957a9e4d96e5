"""Cutting long plans: intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables.

    The cluster names the parent in `spark.checkpoint.dir`. One of our own is made only where that
    is unset and Spark runs in a single local process, as in tests.
    """
    sc = spark.sparkContext
    parent = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not parent:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        parent = tempfile.mkdtemp(prefix="lanwatch-")
        sc.setCheckpointDir(parent)
    return f"{parent}/lanwatch-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs within are deleted when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` and read it back: later steps neither recompute nor replan it, and lost executors
    cost nothing. Being a table, it has sizes for the optimizer and columns to prune. Its shuffle
    files go as soon as it is written, so only those of one step take up disk."""
    path = work_folder(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with _shuffles_go(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
