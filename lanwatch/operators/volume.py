"""Connection-count and traffic-volume spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import SECOND, Config
from ..functions.alerting import cat, evidence, explain, suffix, to_alerts
from ..functions.moments import hour_of_day, weekday, z_score
from .lookup import with_hostname
from .scan import after_learning
from .suppress import cooldown
from .windows import earlier_moments, previous_value


def connection_counts(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Connections per (host, poll interval): one small row per host and minute."""
    step = cfg.poll_interval * SECOND
    return (conn.groupBy("src_ip", (F.floor(F.col("us") / step) * step).cast("bigint").alias("us"))
            .agg(F.count("*").alias("n"), F.min("event_id").alias("event_id")))


def _scored(rows: DataFrame, keys: list[str], value: str, include_current: bool) -> DataFrame:
    """Mean, deviation and size of the history per key, and the z-score of the current value.

    A key has one row per poll here, so its window is bounded by time, not by traffic.
    """
    past = Window.partitionBy(*keys).orderBy("us").rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1)
    v = F.col(value).cast("double")
    return (rows.withColumn("samples", F.count(v).over(past)).withColumn("mean", F.avg(v).over(past))
            .withColumn("sd", F.coalesce(F.stddev_pop(v).over(past), F.lit(0.0)))
            .withColumn("z", z_score(v, F.col("mean"), F.col("sd"))))


def _spike(value: str, factor: float, cfg: Config):
    v, mean = F.col(value), F.col("mean")
    return (F.col("samples") >= cfg.spike_min_samples) & (
        ((mean > 0) & (v > mean * factor)) | (F.col("z") > cfg.spike_z))


def connection_spike(conn: DataFrame, cfg: Config = Config(), devices: DataFrame | None = None,
                     include_current: bool = True) -> DataFrame:
    """Counts far above the host's mean for this hour and weekday.

    By default the current count belongs to the history it is compared with.
    """
    counts = (connection_counts(conn, cfg).withColumn("hour", hour_of_day(F.col("us")))
              .withColumn("day", weekday(F.col("us"))))
    hits = after_learning(_scored(counts, ["src_ip", "hour", "day"], "n", include_current)
                          .where(_spike("n", cfg.spike_factor, cfg)), cfg)
    fired = with_hostname(cooldown(hits, "src_ip", cfg.spike_cooldown), devices, "src_ip")
    src, n, z = F.col("src_ip"), F.col("n"), F.col("z")
    return to_alerts(
        fired, category="connection_anomaly", severity="medium", affected=src,
        confidence=F.least(F.lit(0.95), 0.5 + z * 0.1), dedup_key=cat("conn_spike:", src),
        title=cat("Connection spike: ", src, suffix(F.col("hostname")), " (", n, " active)"),
        description=cat(src, " has ", n, " connections, far above its baseline."),
        action=cat("Check which process on ", src, " opened them."),
        rationale=cat("z-score ", F.round(z, 2)),
        extra={"connection_count": n, "z_score": F.round(z, 2)},
        explanation=explain(
            evidence("active_connections", n, comparison=">", baseline="mean for this hour and weekday"),
            evidence("z_score", F.round(z, 2), baseline="deviations above that mean"),
            basis="0.5 + 0.1 per deviation, at most 0.95"))


def iface_rate(counters: DataFrame) -> DataFrame:
    """Bytes per minute per interface between snapshots of cumulative counters.

    A counter below its predecessor was reset; its own value is then the increase. Snapshots of one time follow each
    other by `event_id`, or by their totals where they have none; between two of them the rate is infinite, or NaN if
    nothing was counted.
    """
    sum_ = F.col("rx_bytes") + F.col("tx_bytes")
    place = F.col("event_id") if "event_id" in counters.columns else sum_
    rows = counters.select("name", "us", place.alias("_place"), F.struct("us", sum_.alias("total")).alias("_now"))
    rows = previous_value(rows, "name", "_now", "_before", tie="_place").where(F.col("_before").isNotNull())
    total, last = F.col("_now.total"), F.col("_before.total")
    minutes = (F.col("us") - F.col("_before.us")) / (60 * SECOND)
    grown = F.when(total >= last, total - last).otherwise(total)
    at_once = F.when(grown == 0, float("nan")).otherwise(float("inf"))
    rate = F.when(minutes == 0, F.when(grown.isNotNull(), at_once)).otherwise(grown / minutes)
    return rows.select("name", "us", rate.alias("bytes_per_minute"))


def traffic_spike(rate: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Interface rates far above the history before them.

    An infinite rate is above every finite history; on a history that holds one, z is NaN, which is above every limit.
    """
    name, z, bpm = F.col("name"), F.col("z"), F.col("bytes_per_minute")
    scored = earlier_moments(rate, "name", "bytes_per_minute", tie="bytes_per_minute").withColumn(
        "z", z_score(bpm, F.col("mean"), F.col("sd")))
    hits = after_learning(scored.where(_spike("bytes_per_minute", cfg.traffic_factor, cfg)), cfg)
    moved = F.coalesce(F.round(bpm, 0).try_cast("bigint").cast("string"), bpm.cast("string"))
    return to_alerts(
        hits, category="traffic_spike", severity="medium", affected=name,
        confidence=F.least(F.lit(0.95), 0.5 + z * 0.1), dedup_key=cat("traffic_spike:", name),
        title=cat("Traffic spike on ", name),
        description=cat(name, " moved ", moved, " bytes per minute."),
        action=cat("Check which host uses ", name, "."), rationale=cat("z-score ", F.round(z, 2)),
        extra={"bytes_per_minute": F.round(bpm, 2), "z_score": F.round(z, 2)})
