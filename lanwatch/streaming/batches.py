"""Micro-batch forms: the batch operators with their memory in tables.

Each batch writes its own `batch_id` partition in overwrite mode and reads only earlier ones, so a
batch that is run again after a failure replaces its first attempt.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import SECOND, Config
from ..functions import tables
from ..operators import baseline, volume
from ..operators.firsts import first_rows, not_in_baseline
from ..operators.lineage import cut
from ..plans import alerts as alert_plans, reports
from ..plans.incidents import incident_evidence, incidents
from .partials import Partials, finished, folders

DAY = 86400 * SECOND
HOUR = 3600 * SECOND


def earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows written by earlier batches, None before the first."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:  # no table yet, or only empty batches
        return None
    return table.where(F.col("batch_id") < batch_id).drop("batch_id")


def put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def first_seen_batches(keys: list[str], baseline: str, out: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: emit keys no earlier batch has seen, and remember them."""
    def run(batch: DataFrame, batch_id: int) -> None:
        seen = earlier(batch.sparkSession, baseline, batch_id)
        fresh = not_in_baseline(first_rows(batch, keys), seen, keys)
        put(fresh, out, batch_id)
        # The emitted rows are the new part of the baseline: read back, not computed twice.
        put(batch.sparkSession.read.parquet(f"{out}/batch_id={batch_id}").select(*keys), baseline, batch_id)
    return run


def _recent(spark: SparkSession, path: str, batch_id: int, since: int) -> DataFrame | None:
    """Rows of earlier batches from `since` on; only the folders of those days are read."""
    table = earlier(spark, path, batch_id)
    return None if table is None else table.where((F.col("day") >= since // DAY) & (F.col("us") >= since)).drop("day")


def _put_by_day(df: DataFrame, path: str, batch_id: int) -> None:
    days = df.withColumn("day", F.floor(F.col("us") / DAY))
    days.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")


def alert_batches(detect: Callable[[DataFrame], DataFrame], out: str, cfg: Config = Config(),
                  prefixes: DataFrame | None = None, correlate: bool = True,
                  mutes: DataFrame | None = None, evidence: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: detect, suppress, enrich, correlate and append fired alerts.

    Batches follow each other in event time. An actor's alerts of earlier batches count towards its
    incidents as long as they lie in the correlation window, so any cut into batches gives the rows of one
    batch. Tables are laid out by day, and only days young enough to matter are read: alerts below `out`,
    the times of incidents, which hold their cooldown, beside it. With `evidence`, a path, the alerts of an
    incident are kept there as rows (`incident_evidence`, by day of the incident) and its alert holds no list of them.
    """
    longest = max(tables.CATEGORY_COOLDOWN_SECONDS.values()) * SECOND
    marks = out.rstrip("/") + "_incidents"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        raw = cut(detect(batch))
        start = raw.agg(F.min("us")).first()[0]
        if start is None:  # nothing found; a retried batch finds the same nothing
            return
        history = _recent(spark, out, batch_id, start - longest)
        seen = None if history is None else history.select("dedup_key", "us")
        fired = alert_plans.fire(raw, cfg, mutes, seen)
        if correlate:
            past = _recent(spark, out, batch_id, start - cfg.correlation_window * SECOND)
            before = _recent(spark, marks, batch_id, start - cfg.correlation_cooldown * SECOND)
            if evidence is not None:
                kept = incident_evidence(fired, cfg, past, before)
                _put_by_day(kept.withColumnRenamed("incident_us", "us"), evidence, batch_id)
            found = cut(incidents(fired, cfg, past, before, timeline=evidence is None))
            fired = fired.unionByName(alert_plans.fire(found, cfg, mutes, seen))
            _put_by_day(found.select(F.col("affected_host").alias("actor"), "us"), marks, batch_id)
        _put_by_day(alert_plans.enrich(fired, prefixes) if prefixes is not None else fired, out, batch_id)
    return run


def report_batches(path: str, now_us: Callable[[], int], stale_s: int = 300) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over the stream of stored alerts: refreshes severity counts and the sensor rollup of the
    last 24 hours (whole hours), and the freshness of every sensor.

    A batch is reduced to hourly counts, which are kept by day. A tick opens the folders of two days, not the alerts;
    a late alert changes the counts of its own hour. The last alert of each sensor is carried from tick to tick. Each
    report is a folder of its own, so a reader always finds a whole one: see `last_report`.
    """
    hours = Partials(f"{path}/hours", ["hour", "severity", "sensor"], {"n": "sum", "last_us": "max"})

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, now_us()
        sensor = F.coalesce("sensor", F.lit("local")).alias("sensor")
        hour = F.floor(F.col("us") / HOUR)
        partial = batch.groupBy(hour.alias("hour"), "severity", sensor).agg(F.count("*").alias("n"), F.max("us").alias("last_us"))
        hours.put(partial.withColumn("day", F.floor(F.col("hour") / 24)), batch_id)
        since = now // HOUR - 24
        kept = hours.read(spark, since // 24)
        recent = None if kept is None else kept.where(F.col("hour") >= since)
        mine = batch.groupBy(sensor).agg(F.max("us").alias("last_us"))
        before = newest(spark, f"{path}/last", batch_id)
        last = mine if before is None else mine.unionByName(before.select("sensor", "last_us")).groupBy("sensor").agg(F.max("last_us").alias("last_us"))
        put(last, f"{path}/last", batch_id)
        fresh = reports.source_freshness(spark.read.parquet(f"{path}/last/batch_id={batch_id}").withColumnRenamed("last_us", "us"), "sensor", now, stale_s)
        report = fresh.select(F.lit("freshness").alias("report"), F.col("sensor").alias("name"), F.col("last_event").alias("value"), "age_seconds", "stale")
        for name, of, value in (("severity", "severity", F.sum("n")), ("sensor", "sensor", F.sum("n")), ("sensor_last", "sensor", F.max("last_us"))):
            if recent is not None:
                report = report.unionByName(recent.groupBy(F.col(of).alias("name")).agg(value.alias("value")).withColumn("report", F.lit(name)),
                                            allowMissingColumns=True)
        put(report.coalesce(1), f"{path}/report", batch_id)
    return run


def newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table written by the latest batch, or by the latest one before `before`."""
    ids = [int(n.split("=")[1]) for n in folders(spark, path) if n.startswith("batch_id=") and finished(spark, f"{path}/{n}")]
    ids = [i for i in ids if before is None or i < before]
    return spark.read.parquet(f"{path}/batch_id={max(ids)}") if ids else None


def last_report(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole report of `report_batches`: (report, name, value, age_seconds, stale)."""
    return newest(spark, f"{path}/report")


# Baselines kept up to date: kind -> (key columns, merge of the others, partial rows of events, final table)
BASELINES: dict[str, tuple] = {
    "hourly": (["src_ip", "us"], {"n": "sum"}, volume.connection_counts, baseline.hourly_of),
    "destinations": (["src_ip", "dst_ip", "dst_port", "protocol"], {"hit_count": "sum", "first_seen": "min", "last_seen": "max"},
                     lambda conn, cfg: baseline.destination_baseline(conn), lambda rows: rows),
    "domains": (["domain"], {"query_count": "sum", "first_seen": "min", "last_seen": "max"}, baseline.dns_baseline, lambda rows: rows),
    "hours": (["ip", "hour"], {"first_seen": "min"}, baseline.host_hours, lambda rows: rows),
    "profile": (["ip", "dimension", "value"], {"first_seen": "min"}, baseline.host_profile, lambda rows: rows),
}


def baseline_table(kind: str, path: str) -> Partials:
    keys, merge, _, _ = BASELINES[kind]
    return Partials(path, keys, merge)


def baseline_batches(kind: str, path: str, cfg: Config = Config()) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: adds the batch to the baseline's day partials, once however often the batch is tried."""
    table, partial = baseline_table(kind, path), BASELINES[kind][2]

    def run(batch: DataFrame, batch_id: int) -> None:
        days = [r[0] for r in batch.select(F.floor(F.col("us") / DAY).alias("d")).distinct().collect()]
        parts = [partial(batch.where(F.floor(F.col("us") / DAY) == d), cfg).withColumn("day", F.lit(d)) for d in days if d is not None]
        if parts:
            table.put(reduce(DataFrame.unionByName, parts), batch_id)
    return run


def read_baseline(spark: SparkSession, kind: str, path: str, first_day: int | None = None) -> DataFrame | None:
    """The baseline of all days, or from a day on; None while there is none. Equal to the operator over all events."""
    rows = baseline_table(kind, path).read(spark, first_day)
    return None if rows is None else BASELINES[kind][3](rows)
