"""Suspicion scores of devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import tables
from ..functions.net import lookup
from ..operators.windows import running_total

MAX_SCORE = 10.0
# Extra score for what a device was seen doing, whether or not the alert fires.
BUMPS = {"arp_conflict": 0.5, "gateway_mac_change": 1.0, "mac_change": 0.3}


def bumps(raw_alerts: DataFrame) -> DataFrame:
    """Score bumps of raw ARP alerts, told apart by the head of their dedup key."""
    kind = F.substring_index("dedup_key", ":", 1)
    return raw_alerts.select("alert_id", F.col("affected_host").alias("ip"), "us",
                             lookup(kind, BUMPS).alias("delta")).where(F.col("delta").isNotNull())


def suspicion(fired: DataFrame, bump_rows: DataFrame | None, devices: DataFrame) -> DataFrame:
    """Score after every event of a known device, at most 10, and its running alert count.

    Increments are never negative, so capping the running sum equals capping at each step.
    """
    d = fired.select(F.concat_ws("|", F.lit("1"), "alert_id").alias("event_id"),
                     F.col("affected_host").alias("ip"), "us",
                     lookup(F.col("severity"), tables.SUSPICION_DELTA, 0.1).alias("delta"),
                     F.lit(True).alias("from_alert"))
    if bump_rows is not None:
        d = d.unionByName(bump_rows.select(
            F.concat_ws("|", F.lit("0"), "alert_id").alias("event_id"), "ip", "us", "delta",
            F.lit(False).alias("from_alert")))
    known = devices.select("ip", F.col("first_seen").alias("_since"))
    d = d.join(known, "ip").where(F.col("us") >= F.col("_since")).drop("_since")
    # Tenths of a millionth as integers: sums do not depend on the order of addition.
    d = d.withColumn("_units", F.round(F.col("delta") * 1_000_000).cast("bigint"))
    return (running_total(d, "ip", "_units", "_total")
            .withColumn("score", F.least(F.lit(MAX_SCORE), F.col("_total") / 1_000_000))
            .withColumnRenamed("_total_rows", "alert_count").drop("_units", "_total", "delta"))


def score_devices(devices: DataFrame, points: DataFrame) -> DataFrame:
    """Inventory with the current `suspicion_score` and `alert_count`."""
    now = points.groupBy("ip").agg(F.max("score").alias("_s"), F.max("alert_count").alias("_n"))
    return (devices.join(now, "ip", "left")
            .withColumn("suspicion_score", F.coalesce("_s", F.lit(0.0)))
            .withColumn("alert_count", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_s", "_n"))


def history(points: DataFrame) -> DataFrame:
    """Trend points: one per fired alert."""
    return points.where("from_alert").select("ip", "us", "score", "event_id")


def suspicion_trend(points: DataFrame, since_us: int | None = None, n: int = 500) -> DataFrame:
    """The newest n points per host, oldest first."""
    rows = points if since_us is None else points.where(F.col("us") >= since_us)
    rank = F.row_number().over(Window.partitionBy("ip").orderBy(F.desc("us"), F.desc("event_id")))
    return (rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
            .orderBy("ip", "us", "event_id"))
