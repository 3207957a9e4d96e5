"""Alerts from batches that come in any order: what late rows change is worked out anew and kept as versions.

Whether an alert fires depends on the one that fired before it, and an incident on the alerts before it. A late row
therefore changes later rows of its key and of its actor, and nothing else. Each batch settles the keys it touches
from its first row of them on, and after them the actors whose alerts changed; it writes the rows that are new or
other than before, and the ids of those that are gone. Once all batches are in, in whatever order, the rows in force
are those that one batch of everything would have given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import SECOND, Config
from ..functions import tables
from ..functions.alerting import ALERT_COLUMNS, ALERT_SCHEMA
from ..operators.lineage import cut
from ..operators.suppress import cooldown
from ..plans.alerts import apply_mutes, cooldown_seconds, quiet_hours
from ..plans.incidents import actor_target, incidents
from .batches import DAY, _put_by_day, _recent
from .partials import finished, folders

LONGEST = max(tables.CATEGORY_COOLDOWN_SECONDS.values())
_COLUMNS = [*ALERT_COLUMNS, "fired"]
_TYPES = {"us": "bigint", "confidence": "double", "fired": "boolean", "gone": "boolean"}


class Versions:
    """Rows (alert_id, us, ...) that batches change, laid out by batch and day. Of each id the latest batch holds."""

    def __init__(self, path: str):
        self.path = path

    def changes(self, spark: SparkSession) -> DataFrame:
        """All changes: the columns of alerts, `fired`, `gone`, batch_id, day."""
        try:
            return spark.read.parquet(self.path)
        except AnalysisException:  # no table yet, or only empty batches
            schema = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in [*_COLUMNS, "gone"])
            return spark.createDataFrame([], f"{schema}, batch_id int, day int")

    def read(self, spark: SparkSession, batches: int, since: int | None = None) -> DataFrame:
        """Rows in force after the batches before number `batches`; from `since` on, which opens no earlier day."""
        rows = self.changes(spark).where(F.col("batch_id") < batches)
        if since is not None:
            rows = rows.where((F.col("day") >= since // DAY) & (F.col("us") >= since))
        latest = rows.groupBy("alert_id").agg(F.max_by(F.struct(*_COLUMNS, "gone"), "batch_id").alias("row"))
        return latest.where("not row.gone").select(*[f"row.{c}" for c in _COLUMNS])

    def put(self, changes: DataFrame, batch_id: int) -> None:
        _put_by_day(changes, self.path, batch_id)

    def batches(self, spark: SparkSession) -> int:
        """One more than the number of the last batch that was written to its end."""
        ids = [int(n.split("=")[1]) for n in folders(spark, self.path) if n.startswith("batch_id=") and finished(spark, f"{self.path}/{n}")]
        return max(ids) + 1 if ids else 0


def _of(rows: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Rows of touched keys, with `_from`, the time from which they are settled anew."""
    t = touched.withColumnRenamed(key, "_key")
    return rows.join(t, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def _starts(rows: DataFrame, key: str) -> DataFrame:
    return cut(rows.groupBy(key).agg(F.min("us").alias("_from")))  # a table: its size tells Spark how to join it


def judged(raw: DataFrame, cfg: Config, mutes: DataFrame | None, history: DataFrame) -> DataFrame:
    """The alerts that start or restart the wait of their key, with `fired`.

    An alert exactly at the limit does not fire but restarts the wait, so such rows are part of what later batches
    must know; `history` holds these rows from before. Alerts of one time are taken by alert_id, then the shortest
    cooldown first; of rows that agree in these the least in the order of all columns. A key's rows are ordered twice:
    in blocks of time by `cooldown`, and, once they are one a cooldown, by key. Both see only what decides; the other
    columns are fetched for the rows that are kept, which are a table of known size.
    """
    rows = quiet_hours(raw, cfg)
    if mutes is not None:
        rows = apply_mutes(rows, mutes)
    order = ["dedup_key", "us", "alert_id", "_quiet"]
    rows = rows.withColumn("_quiet", cooldown_seconds(F.col("category"), F.col("severity")).cast("double"))
    seeds = history.groupBy("dedup_key").agg(F.max("us").alias("us")).select(
        "dedup_key", "us", F.lit("").alias("alert_id"), F.lit(0.000001).alias("_quiet"), F.lit(True).alias("_seed"))
    slim = rows.select(*order, F.lit(False).alias("_seed"))
    kept = cooldown(slim.unionByName(seeds), "dedup_key", F.col("_quiet"), tie="alert_id", longest=LONGEST)
    before = F.lag("us").over(Window.partitionBy("dedup_key").orderBy("us", "alert_id"))
    free = F.col("us") - (F.col("_quiet") * SECOND).cast("bigint") > before
    kept = cut(kept.withColumn("fired", F.coalesce(free, F.lit(True))).where("not _seed").drop("_seed"))
    same = reduce(Column.__and__, [rows[c].eqNullSafe(kept[c]) for c in order])
    whole = rows.join(kept.select(*order), same, "left_semi").groupBy(*order).agg(
        F.min(F.struct(*[c for c in ALERT_COLUMNS if c not in order])).alias("row"))
    same = reduce(Column.__and__, [whole[c].eqNullSafe(kept[c]) for c in order])
    return whole.join(kept, same).select(*[whole[c] for c in order if c != "_quiet"], "row.*", "fired").select(*_COLUMNS)


def _difference(now: DataFrame, old: DataFrame) -> DataFrame:
    """What turns `old` into `now`: rows that are new or other than before, and, marked `gone`, those no longer there."""
    now, old = cut(now.select(*_COLUMNS)), cut(old.select(*_COLUMNS))  # each is read twice
    fresh = now.subtract(old).withColumn("gone", F.lit(False))
    gone = old.join(now.select("alert_id"), "alert_id", "left_anti").withColumn("gone", F.lit(True))
    return cut(fresh.unionByName(gone))


def _after(kept: DataFrame, changes: DataFrame) -> DataFrame:
    same = kept.join(changes.select("alert_id"), "alert_id", "left_anti")
    return same.select(*_COLUMNS).unionByName(changes.where("not gone").select(*_COLUMNS))


def _settle(raw: DataFrame, touched: DataFrame, kept: DataFrame, cfg: Config, mutes: DataFrame | None) -> DataFrame:
    """Changes of the alerts of touched keys, given all their raw alerts and the rows in force."""
    near = _of(kept, touched, "dedup_key")
    again = _of(raw, touched, "dedup_key").where("us >= _from").drop("_from")
    now = judged(again, cfg, mutes, near.where("us < _from"))
    return _difference(now, near.where("us >= _from"))


def _correlate(fired: DataFrame, touched: DataFrame, found: DataFrame, cfg: Config, timeline: bool) -> DataFrame:
    """Changes of the incidents of touched actors, given the alerts and the incidents in force."""
    window = cfg.correlation_window * SECOND
    rows = _of(actor_target(fired), touched, "actor")
    near = _of(found.withColumn("actor", F.col("affected_host")), touched, "actor")
    new = rows.where("us >= _from").select(*ALERT_COLUMNS)
    past = rows.where((F.col("us") < F.col("_from")) & (F.col("us") >= F.col("_from") - window)).select(*ALERT_COLUMNS)
    now = incidents(new, cfg, past, near.where("us < _from").select("actor", "us"), timeline=timeline)
    return _difference(now.withColumn("fired", F.lit(True)), near.where("us >= _from"))


def _tables(path: str) -> tuple[Versions, Versions, Versions]:
    path = path.rstrip("/")
    return Versions(f"{path}/alerts"), Versions(f"{path}/incidents"), Versions(f"{path}/incident_alerts")


def late_alert_batches(detect: Callable[[DataFrame], DataFrame], path: str, cfg: Config = Config(), mutes: DataFrame | None = None,
                       correlate: bool = True, timeline: bool = True) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: like `alert_batches`, but the batches may come in any order of event time.

    Below `path` it keeps the raw alerts, and versions of the fired alerts, of the incidents and of their alerts.
    A batch opens the days from its earliest alert, less one cooldown, on: one day or two where rows are in time, more
    where they are late. Of these it settles the keys and actors it touches. A batch that is tried again replaces its
    first attempt. Alerts without a time are left out; those without a key are a key of their own.
    `alerts_in_force` reads the result, `batch_changes` what one batch raised and withdrew.
    """
    alerts, found, raised = _tables(path)
    raw_path = path.rstrip("/") + "/raw"
    reach = max(LONGEST, cfg.correlation_window, cfg.correlation_cooldown) * SECOND

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _put_by_day(detect(batch).where("us is not null").select(*ALERT_COLUMNS), raw_path, batch_id)
        fresh = spark.read.schema(ALERT_SCHEMA).parquet(f"{raw_path}/batch_id={batch_id}").select(*ALERT_COLUMNS)
        start = fresh.agg(F.min("us")).first()[0]
        if start is None:  # nothing found; a retried batch finds the same nothing
            return
        stored = _recent(spark, raw_path, batch_id, start)
        raw = fresh if stored is None else fresh.unionByName(stored)
        kept = alerts.read(spark, batch_id, start - reach)
        changes = _settle(raw, _starts(fresh, "dedup_key"), kept, cfg, mutes)
        if correlate:
            actors = _starts(actor_target(changes).where("actor is not null"), "actor")
            known = found.read(spark, batch_id, start - reach)
            others = _correlate(_after(kept, changes).where("fired"), actors, known, cfg, timeline)
            raised.put(_settle(_after(known, others), _starts(others, "dedup_key"), raised.read(spark, batch_id, start - reach), cfg, mutes), batch_id)
            found.put(others, batch_id)
        alerts.put(changes, batch_id)  # the last one: its end is the end of the batch
    return run


def alerts_in_force(spark: SparkSession, path: str) -> DataFrame:
    """Fired alerts and alerts of incidents after all finished batches, for `enrich` and the reports."""
    alerts, _, raised = _tables(path)
    n = alerts.batches(spark)
    return alerts.read(spark, n).unionByName(raised.read(spark, n)).where("fired").select(*ALERT_COLUMNS)


def batch_changes(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What a batch changed, for receivers that keep alerts by `alert_id`: rows to put in, and, with `withdrawn`, rows
    to take out if they are there."""
    alerts, _, raised = _tables(path)
    rows = alerts.changes(spark).unionByName(raised.changes(spark)).where(F.col("batch_id") == batch_id)
    return rows.select(*ALERT_COLUMNS, (F.col("gone") | ~F.col("fired")).alias("withdrawn"))
