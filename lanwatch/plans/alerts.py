"""From raw alerts to fired alerts: quiet hours, mutes, dedup, enrichment, status, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SECOND, Config
from ..functions import tables
from ..functions.alerting import ALERT_COLUMNS, at_least, cat
from ..functions.moments import in_quiet_hours
from ..functions.net import is_private_ip, is_valid_ip, lookup
from ..operators.lookup import prefix_facts
from ..operators.suppress import cooldown
from ..operators.lineage import cut

MUTE_SECONDS = 7 * 86400


def union_alerts(*parts: DataFrame) -> DataFrame:
    """All detector outputs as one alert table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def quiet_hours(alerts: DataFrame, cfg: Config) -> DataFrame:
    """Inside quiet hours only high and critical alerts pass."""
    if not cfg.quiet_enabled:
        return alerts
    quiet = in_quiet_hours(F.col("us"), cfg.quiet_start, cfg.quiet_end, cfg.quiet_tz)
    return alerts.where(~quiet | at_least(F.col("severity"), "high"))


def cooldown_seconds(category: Column, severity: Column) -> Column:
    by_category = lookup(category, tables.CATEGORY_COOLDOWN_SECONDS, tables.DEFAULT_COOLDOWN_SECONDS)
    return F.when(severity == "critical", F.least(by_category, F.lit(tables.CRITICAL_COOLDOWN_SECONDS))
                  ).otherwise(by_category)


def apply_mutes(alerts: DataFrame, mutes: DataFrame) -> DataFrame:
    """Drop alerts of a muted key from the mute until seven days and its cooldown have passed.

    `mutes` has (dedup_key, us).
    """
    m = mutes.select(F.col("dedup_key").alias("_key"), F.col("us").alias("_from"))
    wait = (MUTE_SECONDS + cooldown_seconds(F.col("category"), F.col("severity"))).cast("bigint")
    until = F.col("_from") + wait * SECOND
    return alerts.join(m, (F.col("dedup_key") == F.col("_key")) & (F.col("us") >= F.col("_from"))
                       & (F.col("us") < until), "left_anti")


def dedup(alerts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Fire an alert only when more than its category's cooldown passed since its key last fired.

    A critical alert waits 120 seconds at most. `history` (dedup_key, us) holds alerts fired before
    this batch; one seed row per key carries them in.
    """
    columns = alerts.columns
    rows = alerts.withColumn("_quiet", cooldown_seconds(F.col("category"), F.col("severity")).cast("double"))
    rows = rows.withColumn("_seed", F.lit(False))
    if history is not None:
        seeds = history.groupBy("dedup_key").agg(F.max("us").alias("us")).select(
            "dedup_key", "us", F.lit("").alias("alert_id"), F.lit(0.000001).alias("_quiet"),
            F.lit(True).alias("_seed"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    longest = max(tables.CATEGORY_COOLDOWN_SECONDS.values())
    fired = cooldown(rows, "dedup_key", F.col("_quiet"), tie="alert_id", strict=True, longest=longest)
    return fired.where(~F.col("_seed")).select(*columns)


def with_status(alerts: DataFrame, status_events: DataFrame) -> DataFrame:
    """Latest status of each alert; `status_events` has (alert_id, us, status)."""
    last = status_events.groupBy("alert_id").agg(F.max_by("status", "us").alias("_status"))
    return (alerts.join(last, "alert_id", "left")
            .withColumn("status", F.coalesce("_status", "status")).select(*alerts.columns))


def enrich(alerts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Country and network of the first public address of (related, affected) that has data.

    Adds an `enrichment` object to `extra` and a suffix to the description; enriched rows stay.
    """
    hosts = alerts.select(F.explode(F.array("related_host", "affected_host")).alias("ip")).distinct()
    public = hosts.where(is_valid_ip(F.col("ip")) & ~is_private_ip(F.col("ip")))
    known = prefix_facts(public, "ip", prefixes).where((F.col("country") != "") | (F.col("asn") != 0))
    name = F.when(F.col("country_name") != "", F.col("country_name")).otherwise(F.col("country"))
    has_country, has_asn = F.col("country") != "", F.col("asn") != 0
    facts = known.select(
        F.col("ip").alias("_ip"),
        F.struct(
            F.to_json(F.struct(
                "ip", F.when(has_country, F.col("country")).alias("country"),
                F.when(has_country, name).alias("country_name"),
                F.when(has_asn, F.col("asn")).alias("asn"),
                F.when(has_asn, F.col("org")).alias("asn_org"))).alias("json"),
            F.concat_ws(", ", F.when(has_country, name), F.when(has_asn, cat(
                "AS", F.col("asn"), F.when(F.col("org") != "", cat(" ", F.col("org"))).otherwise("")))
            ).alias("text")).alias("_facts"))
    rel = facts.withColumnsRenamed({"_ip": "_rip", "_facts": "_rf"})
    aff = facts.withColumnsRenamed({"_ip": "_aip", "_facts": "_af"})
    joined = (alerts.join(rel, alerts["related_host"] == rel["_rip"], "left")
              .join(aff, alerts["affected_host"] == aff["_aip"], "left"))
    best = F.coalesce("_rf", "_af")
    fresh = best.isNotNull() & F.get_json_object("extra", "$.enrichment").isNull()
    body = F.regexp_replace("extra", r"\}\s*$", "")
    comma = F.when(F.trim(body) == "{", "").otherwise(",")
    return joined.withColumn("_best", best).withColumn("_fresh", fresh).select(
        *[c for c in alerts.columns if c not in ("extra", "description")],
        F.when(F.col("_fresh"), F.concat(body, comma, F.lit('"enrichment":'), F.col("_best.json"),
                                         F.lit("}"))).otherwise(F.col("extra")).alias("extra"),
        F.when(F.col("_fresh"), cat(F.col("description"), " [", F.col("_best.text"), "]"))
        .otherwise(F.col("description")).alias("description")).select(*alerts.columns)


def suppression_stats(raw: DataFrame, fired: DataFrame) -> DataFrame:
    """One row: processed, suppressed, fired, suppression rate."""
    flagged = raw.select(F.lit(1).alias("p"), F.lit(0).alias("f")).unionByName(
        fired.select(F.lit(0).alias("p"), F.lit(1).alias("f")))
    one = flagged.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("total_processed"),
                      F.coalesce(F.sum("f"), F.lit(0)).alias("total_fired"))
    processed, done = F.col("total_processed"), F.col("total_fired")
    return one.select(processed, (processed - done).alias("total_suppressed"), done,
                      F.when(processed > 0, (processed - done) / processed).otherwise(0.0)
                      .alias("suppression_rate"))


def fire(alerts: DataFrame, cfg: Config, mutes: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Alerts that pass quiet hours, mutes and dedup, as a table."""
    out = quiet_hours(alerts, cfg)
    if mutes is not None:
        out = apply_mutes(out, mutes)
    return cut(dedup(out, history))


def process(alerts: DataFrame, cfg: Config = Config(), prefixes: DataFrame | None = None,
            mutes: DataFrame | None = None, history: DataFrame | None = None,
            correlate: bool = True) -> DataFrame:
    """Quiet hours, mutes, dedup and enrichment; then incidents of the fired alerts, which pass
    through the same steps once and are never correlated again."""
    from .incidents import incidents

    fired = fire(alerts, cfg, mutes, history)
    if correlate:
        # Enrichment changes nothing that correlation looks at, so it runs once, at the end.
        fired = fired.unionByName(fire(incidents(fired, cfg), cfg, mutes, history))
    return enrich(fired, prefixes) if prefixes is not None else fired


def search(alerts: DataFrame, since_us: int | None = None, severity: str | None = None,
           status: str | None = None, host: str | None = None, sensor: str | None = None,
           limit: int | None = None) -> DataFrame:
    """Alerts that match all given criteria, newest first, at most `limit` where that is given; sensor `local` means raised here."""
    out = alerts
    if since_us is not None:
        out = out.where(F.col("us") >= since_us)
    for column, value in (("severity", severity), ("status", status), ("affected_host", host)):
        if value:
            out = out.where(F.col(column) == value)
    if sensor:
        out = out.where(F.col("sensor").isNull() if sensor == "local" else F.col("sensor") == sensor)
    out = out.orderBy(F.desc("us"), "alert_id")
    return out.limit(limit) if limit is not None else out


def dns_search(observations: DataFrame, since_us: int, src_ip: str | None = None) -> DataFrame:
    out = observations.where(F.col("us") >= since_us)
    if src_ip:
        out = out.where(F.col("src_ip") == src_ip)
    return out.orderBy(F.desc("us"))


def by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def latest_device(devices: DataFrame, *, ip: str | None = None, mac: str | None = None) -> DataFrame:
    """Newest inventory row of an address or MAC."""
    hit = F.col("ip") == ip if ip else F.col("mac") == mac
    return devices.where(hit).orderBy(F.desc("last_seen")).limit(1)
