"""Incidents: alerts of one actor correlated across sensors, targets and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SECOND, Config
from ..functions.alerting import cat, severity_name, severity_rank, to_alerts
from ..functions.moments import iso_utc
from ..functions.names import once
from ..operators.lineage import cut
from ..operators.suppress import cooldown
from ..operators.windows import sliding_distinct, with_lookback

# Ordered stages of an intrusion by one host.
STAGES = ["new_device", "port_scan", "lateral_movement"]


def actor_target(alerts: DataFrame) -> DataFrame:
    """Add `actor` (who acted) and `target` (who was acted upon; null when it is the actor)."""
    affected, related = (F.nullif(c, F.lit("")) for c in ("affected_host", "related_host"))
    moving = F.col("category").isin("port_scan", "lateral_movement")
    login = F.nullif(F.get_json_object("extra", "$.src_ip"), F.lit(""))
    actor = (F.when(moving, F.coalesce(related, affected))
             .when(F.col("category") == "auth_anomaly", F.coalesce(login, related, affected))
             .otherwise(F.coalesce(affected, related)))
    target = F.when(moving, affected).otherwise(related)
    found = once(once(alerts, actor=actor), target=target)
    return found.withColumn("target", F.when(F.col("target") != F.col("actor"), F.col("target")))


def _stage_start(rows: DataFrame, window_us: int) -> DataFrame:
    """Add `stage_start`: the latest time at which a stage sequence completed by now began."""
    order = (Window.partitionBy("actor", "_bucket").orderBy("us", "alert_id")
             .rowsBetween(Window.unboundedPreceding, 0))
    out = with_lookback(rows, window_us).repartition("actor", "_bucket")
    begun = F.col("us")
    for i, stage in enumerate(STAGES):
        out = out.withColumn(f"_s{i}", F.max(F.when(F.col("category") == stage, begun)).over(order))
        begun = F.col(f"_s{i}")
    return (out.where("_own").withColumn("stage_start", begun)
            .drop("_own", "_bucket", *[f"_s{i}" for i in range(len(STAGES))]))


_EVENT = ["alert_id", "category", "severity", "title", "affected_host", "related_host", "sensor", "target"]


def _evidence(fired: DataFrame, rows: DataFrame, window_us: int) -> DataFrame:
    """One row for each incident (the columns of `fired`) and alert of its actor in [us - window, us], whose time is `alert_us`."""
    b = F.floor(F.col("us") / window_us).cast("bigint")
    want = fired.withColumn("_b", F.explode(F.array(b, b - 1)))
    have = rows.select("actor", F.col("us").alias("alert_us"), b.alias("_b"), *_EVENT)
    return (want.drop("alert_id").join(have, ["actor", "_b"]).drop("_b")
            .where((F.col("alert_us") <= F.col("us")) & (F.col("alert_us") >= F.col("us") - window_us)))


def _members(fired: DataFrame, rows: DataFrame, window_us: int) -> DataFrame:
    """Attach `events`: the actor's alerts in [us - window, us], time-ordered."""
    event = F.struct(F.col("alert_us").alias("us"), *_EVENT)
    keys = [c for c in fired.columns if c != "alert_id"]
    return _evidence(fired, rows, window_us).groupBy(*keys).agg(F.sort_array(F.collect_list(event)).alias("events"))


def _story_times(found: DataFrame) -> DataFrame:
    """(actor, us, s0, s1, ...): the first alert of each stage after that of the stage before, by minima in place of lists."""
    out = found.select("actor", "us").distinct()
    for i, stage in enumerate(STAGES):
        of = found.where(F.col("category") == stage).join(out, ["actor", "us"])
        at = F.struct("alert_us", "alert_id")
        after = of if not i else of.where(at > F.col(f"s{i - 1}"))
        out = out.join(after.groupBy("actor", "us").agg(F.min(at).alias(f"s{i}")), ["actor", "us"], "left")
    return out


def _summed(found: DataFrame) -> DataFrame:
    """One row an incident: what is known of its alerts without a list of them."""
    rank = severity_rank(F.col("severity"))
    keys = ["actor", "us", "n_sensors", "n_targets", "broad"]
    named = F.nullif("sensor", F.lit(""))
    return found.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("alert_us").alias("first"), F.max(rank).alias("rank"),
        F.array_sort(F.collect_set(F.nullif("category", F.lit("")))).alias("categories"),  # of a fixed list
        F.countDistinct(named).alias("n_named"))


def _timeline(events):
    return F.transform(events, lambda e: F.struct(
        iso_utc(e["us"]).alias("timestamp"), e["category"].alias("category"),
        e["severity"].alias("severity"), e["title"].alias("title"),
        e["affected_host"].alias("affected_host"), e["related_host"].alias("related_host")))


def _in_order(events):
    """First events that match the stages in order."""
    stages = F.array(*[F.lit(s) for s in STAGES])
    empty = F.filter(events, lambda e: F.lit(False))
    return F.aggregate(events, empty, lambda got, e: F.when(
        e["category"] == F.try_element_at(stages, F.size(got) + 1),
        F.concat(got, F.array(e))).otherwise(got))


def _fired(alerts: DataFrame, cfg: Config, past: DataFrame | None, marks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Incidents (actor, us, alert_id, n_sensors, n_targets, broad), and the alerts that may belong to them."""
    window = cfg.correlation_window * SECOND
    alerts = alerts.withColumn("_new", F.lit(True))
    if past is not None:
        alerts = alerts.unionByName(past.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    rows = actor_target(alerts.where("category != 'incident'")).where(F.col("actor").isNotNull())
    rows = rows.withColumn("sensor", F.coalesce("sensor", F.lit("local"))).select(
        "alert_id", "us", "actor", "target", "sensor", "category", "severity", "title",
        "affected_host", "related_host", "_new")
    slim = rows.select("alert_id", "us", "actor", "target", "sensor", "category", "_new")
    # The window is closed at its far end, hence one microsecond more than the half-open one.
    counted = sliding_distinct(_stage_start(slim, window + 1), ["actor"], ["sensor", "target"],
                               window + 1, ["n_sensors", "n_targets"])
    broad = (F.col("n_sensors") >= cfg.correlation_sensors) | (
        F.col("n_targets") >= cfg.correlation_targets)
    staged = F.coalesce(F.col("stage_start") >= F.col("us") - window, F.lit(False))
    hits = counted.withColumn("broad", broad).where(F.col("_new") & (broad | staged)) \
        .select("alert_id", "us", "actor", "n_sensors", "n_targets", "broad")
    if marks is not None:
        seeds = marks.groupBy("actor").agg(F.max("us").alias("us")).withColumn("_seed", F.lit(True))
        hits = hits.unionByName(seeds, allowMissingColumns=True)
    fired = cooldown(hits, "actor", cfg.correlation_cooldown, tie="alert_id")
    if marks is not None:
        fired = fired.where("_seed is null").drop("_seed")
    return fired, rows


def incident_evidence(alerts: DataFrame, cfg: Config = Config(), past: DataFrame | None = None,
                      marks: DataFrame | None = None) -> DataFrame:
    """(actor, incident_us, alert_id, alert_us, category, severity, affected_host, related_host, sensor, target, stage):
    one row for each incident and alert that belongs to it.

    An incident is named by actor and time, which are `affected_host` and `us` of its alert. `stage` numbers the alerts
    (from 1) that carry a stage sequence; it is null for other alerts and for incidents of breadth. The table has as
    many rows as incidents have alerts, however many one actor raises; nothing is gathered.
    """
    fired, rows = _fired(alerts, cfg, past, marks)
    fired = cut(fired)  # the incidents, read once for the table and once for each stage
    found = _evidence(fired, rows, cfg.correlation_window * SECOND)
    steps = _story_times(found.where("not broad"))
    at = F.struct("alert_us", "alert_id")
    number = F.coalesce(*[F.when(at == F.col(f"s{i}"), i + 1) for i in range(len(STAGES))])
    return found.join(steps, ["actor", "us"], "left").select(
        "actor", F.col("us").alias("incident_us"), "alert_id", "alert_us", "category", "severity", "affected_host",
        "related_host", "sensor", "target", number.alias("stage"))


def incidents(alerts: DataFrame, cfg: Config = Config(), past: DataFrame | None = None,
              marks: DataFrame | None = None, timeline: bool = True) -> DataFrame:
    """Incident alerts: an actor seen by enough sensors, hitting enough targets, or passing all
    stages in order, within the window; one per cooldown. Breadth wins over the stage sequence.

    With earlier batches, `past` holds their alerts of the last window, which count but complete no
    incident here, and `marks` (actor, us) their incidents, which hold the cooldown.

    Without `timeline` the alerts carry counts, times, categories and the peak severity, but no lists of alerts,
    hosts or sensors; `incident_evidence` gives those as rows. Take it where one actor may raise millions of alerts.
    """
    window = cfg.correlation_window * SECOND
    fired, rows = _fired(alerts, cfg, past, marks)
    if not timeline:
        return _brief(_summed(_evidence(fired, rows, window)), cfg)
    full = _members(fired, rows, window)

    def names(field):
        return F.array_sort(F.array_distinct(F.filter(
            F.col(f"events.{field}"), lambda x: F.coalesce(x, F.lit("")) != "")))

    ev, is_broad = F.col("events"), F.col("broad")
    story = F.when(is_broad, ev).otherwise(_in_order(ev))
    peak = severity_name(F.array_max(F.transform(ev, lambda e: severity_rank(e["severity"]))))
    full = full.withColumn("story", story)
    return _alert(full, cfg, F.size("events"), peak, {
        "event_count": F.size("story"),
        "sensors": F.when(is_broad, names("sensor")), "target_count": F.when(is_broad, F.col("n_targets")),
        "affected_hosts": F.when(is_broad, names("affected_host")),
        "categories": F.when(is_broad, names("category")),
        "first_seen": F.when(is_broad, iso_utc(F.element_at("events", 1)["us"])),
        "peak_severity": F.when(is_broad, peak),
        "sequence": F.when(~is_broad, F.col("story.category")),
        "timeline": _timeline(F.col("story"))})


def _brief(summed: DataFrame, cfg: Config) -> DataFrame:
    is_broad, peak = F.col("broad"), severity_name(F.col("rank"))
    return _alert(summed, cfg, F.col("n"), peak, {
        "event_count": F.when(is_broad, F.col("n")).otherwise(len(STAGES)),
        "sensor_count": F.when(is_broad, F.col("n_named")), "target_count": F.when(is_broad, F.col("n_targets")),
        "categories": F.when(is_broad, F.col("categories")),
        "first_seen": F.when(is_broad, iso_utc(F.col("first"))),
        "peak_severity": F.when(is_broad, peak),
        "sequence": F.when(~is_broad, F.array(*map(F.lit, STAGES)))})


def _alert(full: DataFrame, cfg: Config, n: Column, peak: Column, extra: dict[str, Column]) -> DataFrame:
    actor, is_broad = F.col("actor"), F.col("broad")
    n_s, n_t = F.col("n_sensors"), F.col("n_targets")
    return to_alerts(
        full, category="incident", affected=actor,
        severity=F.when(is_broad & ((n_s >= 3) | (n_t >= 20)), "critical").otherwise("high"),
        confidence=F.when(is_broad, 0.8).otherwise(0.85),
        dedup_key=F.when(is_broad, cat("incident:", actor)).otherwise(cat("incident:sequence:", actor)),
        title=F.when(is_broad, cat("Correlated incident: ", actor, " active across ", n_s,
                                   " sensor(s), ", n_t, " target(s)"))
        .otherwise(cat("Possible intrusion sequence: ", actor)),
        description=F.when(is_broad, cat(actor, " caused ", n, " alerts in ",
                                         f"{cfg.correlation_window} s, up to ", peak, "."))
        .otherwise(cat(actor, " appeared, scanned and moved on, in this order.")),
        action=cat("Investigate ", actor, " along the timeline and consider isolating it."),
        rationale=cat(n, " correlated alerts"),
        extra={"actor": actor, **extra})
