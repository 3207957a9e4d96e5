"""First-seen operators and baseline membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_rows(df: DataFrame, keys: list[str], ts: str = "us", tie: str = "event_id") -> DataFrame:
    """Earliest row per key. An aggregate, so rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in (ts, tie)]
    best = F.min_by(F.struct(*[F.col(c) for c in [ts, tie] + rest]), F.struct(ts, tie))
    return df.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*")


def not_in_baseline(df: DataFrame, baseline: DataFrame | None, keys: list[str]) -> DataFrame:
    if baseline is None:
        return df
    return df.join(baseline.select(*keys).distinct(), keys, "left_anti")


def known_in_baseline(df: DataFrame, baseline: DataFrame | None, keys: list[str],
                      out: str = "known") -> DataFrame:
    """Flag rows whose key is in the baseline."""
    if baseline is None:
        return df.withColumn(out, F.lit(False))
    known = baseline.select(*keys).distinct().withColumn("_known", F.lit(True))
    return (df.join(known, keys, "left")
            .withColumn(out, F.coalesce("_known", F.lit(False))).drop("_known"))


def first_seen(df: DataFrame, key: list[str], value: str, baseline: DataFrame | None = None,
               ts: str = "us", tie: str = "event_id") -> DataFrame:
    """First row per (key, value) not in the baseline; `known` = values known before it.

    The ranking window runs over first sightings only: a host has at most as many rows there as
    the value has distinct members (24 hours, 65,536 ports, the hosts of the subnet ...).
    """
    fresh = not_in_baseline(first_rows(df, [*key, value], ts, tie), baseline, [*key, value])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(ts, tie, value)) - 1
    if baseline is None:
        return fresh.withColumn("known", rank.cast("bigint"))
    sizes = baseline.groupBy(*key).agg(F.count_distinct(value).alias("_base"))
    return (fresh.withColumn("_rank", rank).join(sizes, key, "left")
            .withColumn("known", (F.col("_rank") + F.coalesce("_base", F.lit(0))).cast("bigint"))
            .drop("_rank", "_base"))
