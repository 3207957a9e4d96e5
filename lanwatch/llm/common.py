"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lineage import cut

__all__ = ["cut", "exists", "fresh", "lower_ascii", "read", "small", "text_slices"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or the name with underscores added where `df` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, a written table, marked for broadcast if it has at most so many rows; beyond, Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are. Texts of one byte a character take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the texts of column `text` exceed `limit` bytes (one longer text comes alone)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
