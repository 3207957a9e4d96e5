"""Partial aggregates kept by day, to which micro-batches add exactly once.

Layout: day=D/batch=N holds what batch N adds to day D, day=D/upto=M the merged rows of all batches up to M. A batch
that is tried again replaces its own folders. A compaction only adds folders, so readers are never disturbed, and
what it makes superfluous may be deleted at any time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in whatever store; none where it is missing."""
    where, store = _files(spark, path)
    return [f.getPath().getName() for f in store.listStatus(where) if f.isDirectory()] if store.exists(where) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder came to its end."""
    where, store = _files(spark, f"{path}/_SUCCESS")
    return store.exists(where)


class Partials:
    def __init__(self, path: str, keys: list[str], merge: dict[str, str]):
        """`keys`: columns that tell rows apart; `merge`: column -> sum, min or max."""
        self.path, self.keys, self.merge = path.rstrip("/"), keys, merge

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[_MERGE[how](c).alias(c) for c, how in self.merge.items()])

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Add rows (day, keys, values) as batch `batch_id`, in place of an earlier attempt."""
        spark = rows.sparkSession
        days = [r[0] for r in rows.select("day").distinct().collect()]  # one small number a day
        where, store = _files(spark, self.path)
        for day in set(self._days(spark)) - set(days):  # of an attempt that saw other rows
            old, _ = _files(spark, f"{self.path}/day={day}/batch={batch_id}")
            if store.exists(old):
                store.delete(old, True)
        for day in days:
            part = rows.where(F.col("day") == day).drop("day")
            self.merged(part).write.mode("overwrite").parquet(f"{self.path}/day={day}/batch={batch_id}")

    def _days(self, spark: SparkSession) -> list[int]:
        return sorted(int(n[4:]) for n in folders(spark, self.path) if n.startswith("day="))

    def _parts(self, spark: SparkSession, day: int) -> tuple[int, list[str]]:
        """Up to which batch the day is merged (-1: not), and the folders that make it up."""
        here = f"{self.path}/day={day}"
        ids = {kind: [int(n.split("=")[1]) for n in folders(spark, here) if n.startswith(kind) and finished(spark, f"{here}/{n}")]
               for kind in ("upto=", "batch=")}
        upto = max(ids["upto="], default=-1)
        return upto, [f"{here}/upto={upto}"] * (upto >= 0) + [f"{here}/batch={b}" for b in sorted(ids["batch="]) if b > upto]

    def opened(self, spark: SparkSession, first_day: int | None = None) -> list[str]:
        """The folders that a read from `first_day` on opens."""
        return [f for day in self._days(spark) if first_day is None or day >= first_day for f in self._parts(spark, day)[1]]

    def read(self, spark: SparkSession, first_day: int | None = None) -> DataFrame | None:
        """Merged rows of all days, or of those from `first_day` on; None where there are none."""
        paths = self.opened(spark, first_day)
        return self.merged(spark.read.parquet(*paths)) if paths else None

    def compact(self, spark: SparkSession, before_day: int, upto: int) -> int:
        """Merge the batches up to `upto` (all of them ended for good) of each day before `before_day`; returns how many
        days changed. Later batches may still add to these days."""
        changed = 0
        for day in (d for d in self._days(spark) if d < before_day):
            done, parts = self._parts(spark, day)
            due = [p for p in parts if "/upto=" in p or int(p.rsplit("=", 1)[1]) <= upto]
            if len(due) > 1:
                rows = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in due])
                self.merged(rows).write.mode("overwrite").parquet(f"{self.path}/day={day}/upto={upto}")
                changed += 1
        return changed
