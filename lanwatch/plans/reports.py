"""Reports, top lists and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import SECOND
from ..functions.net import port_service

_DAY = 86400 * SECOND


def alerts_by_severity(alerts: DataFrame, since_us: int) -> DataFrame:
    return alerts.where(F.col("us") >= since_us).groupBy("severity").agg(F.count("*").alias("cnt"))


def sensor_rollup(alerts: DataFrame, since_us: int | None = None) -> DataFrame:
    """Alert count and last alert per sensor; alerts raised here count as `local`."""
    rows = alerts if since_us is None else alerts.where(F.col("us") >= since_us)
    return (rows.groupBy(F.coalesce("sensor", F.lit("local")).alias("sensor"))
            .agg(F.count("*").alias("alert_count"), F.max("us").alias("last_seen"))
            .orderBy(F.desc("last_seen")))


def top_suspicious(devices: DataFrame, k: int = 10) -> DataFrame:
    return devices.orderBy(F.desc("suspicion_score"), F.desc("alert_count"), "ip").limit(k)


def top_domains(dns_baseline: DataFrame, k: int = 20) -> DataFrame:
    return dns_baseline.orderBy(F.desc("query_count"), "domain").limit(k)


def _top(rows: DataFrame, key: str, order: list, k: int | None) -> DataFrame:
    """First k rows per key (all, if k is None); Spark prunes to k per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = rows.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def port_rollup(destinations: DataFrame, k: int = 15) -> DataFrame:
    """Services each host talks to: distinct destinations and connections per (port, protocol).

    The distinct count runs on the destination baseline, which has one row per destination.
    """
    rows = destinations.groupBy("src_ip", "dst_port", "protocol").agg(
        F.count_distinct("dst_ip").alias("destinations"), F.sum("hit_count").alias("connections"),
        F.max("last_seen").alias("last_seen")).withColumn("service", port_service(F.col("dst_port")))
    return _top(rows, "src_ip", [F.desc("connections"), F.desc("destinations"), "dst_port", "protocol"], k)


def top_destinations(destinations: DataFrame, k: int = 25) -> DataFrame:
    return _top(destinations, "src_ip", [F.desc("hit_count"), F.desc("last_seen"), "dst_ip", "dst_port",
                                         "protocol"], k)


def dns_summary(observations: DataFrame, k: int = 25) -> DataFrame:
    """Per host and queried (name, type): queries, failures, last time; newest k per host."""
    rows = observations.groupBy("src_ip", "query_name", "query_type").agg(
        F.count("*").alias("query_count"), F.count_if("is_nxdomain").alias("nxdomain_count"),
        F.max("us").alias("last_seen"))
    return _top(rows, "src_ip", [F.desc("last_seen"), "query_name", "query_type"], k)


def daily_report(alerts: DataFrame, devices: DataFrame, now_us: int, top: int = 10) -> DataFrame:
    """Rows (section, name, value) for the last 24 hours.

    Totals and counts by severity, category and host come from one grouping-sets pass.
    """
    since = now_us - _DAY
    day = alerts.where((F.col("us") >= since) & (F.col("us") <= now_us))
    sets = day.groupingSets(
        [["severity"], ["category"], ["affected_host"], []], "severity", "category", "affected_host"
    ).agg(F.count("*").alias("value"), F.grouping_id().alias("g"))
    section = (F.when(F.col("g") == 3, "alerts_by_severity").when(F.col("g") == 5, "alerts_by_category")
               .when(F.col("g") == 6, "top_alerting_hosts").otherwise("total_alerts"))
    counts = sets.select(section.alias("section"),
                         F.coalesce("severity", "category", "affected_host", F.lit("")).alias("name"), "value")
    hosts = counts.where("section = 'top_alerting_hosts' and name != ''").orderBy(
        F.desc("value"), "name").limit(top)
    fresh = devices.where(F.col("first_seen") > since).select(
        F.lit("new_devices").alias("section"), F.col("ip").alias("name"), F.lit(1).cast("bigint").alias("value"))
    known = devices.agg(F.count("*").alias("value")).select(
        F.lit("total_known_devices").alias("section"), F.lit("").alias("name"), "value")
    return (counts.where("section != 'top_alerting_hosts'").unionByName(hosts)
            .unionByName(fresh).unionByName(known))


def host_detail(devices: DataFrame, alerts: DataFrame, destinations: DataFrame, dns: DataFrame,
                profile: DataFrame, hours: DataFrame, countries: DataFrame, points: DataFrame,
                since_us: int, actions: DataFrame | None = None, hosts: list[str] | None = None,
                max_alerts: int | None = None, max_points: int | None = None,
                max_actions: int | None = None) -> DataFrame:
    """One row per device with its recent alerts, destinations, DNS, profile, ports and trend.

    Lists of destinations, names and ports are cut to their top-k before they are collected. Alerts, points of the
    trend and actions are all listed unless a number is given: give one where a host may have very many.
    """
    def pick(df, col):
        return df if hosts is None else df.where(F.col(col).isin(hosts))

    def listed(df, key, fields, name):
        return df.groupBy(F.col(key).alias("ip")).agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    recent = _top(pick(alerts.where(F.col("us") >= since_us), "affected_host"), "affected_host",
                  [F.desc("us"), "alert_id"], max_alerts)
    values = pick(profile, "ip")
    ports = values.where("dimension = 'dst_port'").withColumn("port", F.col("value").cast("int"))
    peers = values.where("dimension = 'peer'")
    parts = [
        listed(recent, "affected_host", ["rank", "alert_id", "us", "severity", "title"], "recent_alerts"),
        listed(top_destinations(pick(destinations, "src_ip")), "src_ip",
               ["rank", "dst_ip", "dst_port", "protocol", "hit_count"], "known_destinations"),
        listed(dns_summary(pick(dns, "src_ip")), "src_ip",
               ["rank", "query_name", "query_type", "query_count", "nxdomain_count"], "dns_history"),
        listed(port_rollup(pick(destinations, "src_ip")), "src_ip",
               ["rank", "dst_port", "protocol", "service", "destinations", "connections"], "port_rollup"),
        ports.groupBy("ip").agg(F.sort_array(F.collect_set("port")).alias("destination_ports")),
        peers.groupBy("ip").agg(F.sort_array(F.collect_set("value")).alias("internal_peers")),
        pick(hours, "ip").groupBy("ip").agg(F.sort_array(F.collect_set("hour")).alias("active_hours")),
        pick(countries, "src_ip").groupBy(F.col("src_ip").alias("ip")).agg(
            F.sort_array(F.collect_set("country")).alias("countries")),
        listed(_top(pick(points, "ip").where(F.col("us") >= since_us), "ip",
                    [F.desc("us"), F.desc("event_id")], max_points), "ip", ["us", "score"], "suspicion_trend"),
    ]
    if actions is not None:
        parts.append(listed(_top(actions, "target", [F.desc("us"), "action_id"], max_actions), "target",
                            ["us", "responder", "status", "description"], "response_actions"))
    out = pick(devices, "ip")
    for p in parts:
        out = out.join(p, "ip", "left")
    return out


def status(alerts: DataFrame, devices: DataFrame, now_us: int, stats: DataFrame | None = None,
           baseline: DataFrame | None = None) -> DataFrame:
    """Rows (item, value): alert counts of 24 hours, device count, suppression and baseline sizes."""
    counts = alerts_by_severity(alerts.where(F.col("us") <= now_us), now_us - _DAY).select(
        F.concat(F.lit("alerts_24h_"), "severity").alias("item"), F.col("cnt").cast("double").alias("value"))
    out = counts.unionByName(devices.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("device_count").alias("item"), "value"))
    for one in (stats, baseline):
        if one is not None:
            names = [f.name for f in one.schema.fields]
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value"))
                                        for n in names]))
            out = out.unionByName(one.select(pairs.alias("p")).select("p.*"))
    return out


def alert_view(alerts: DataFrame) -> DataFrame:
    """Listing columns with the nested parts of `extra` pulled out."""
    return alerts.select(
        "alert_id", "us", "severity", "category", "affected_host", "affected_mac", "related_host",
        "title", "description", "recommended_action", F.round("confidence", 3).alias("confidence"),
        "status", F.get_json_object("extra", "$.enrichment").alias("enrichment"),
        F.coalesce("sensor", F.lit("local")).alias("sensor"),
        F.get_json_object("extra", "$.timeline").alias("timeline"),
        F.get_json_object("extra", "$.explanation").alias("explanation"), "confidence_rationale")


def source_freshness(events: DataFrame, source: str, now_us: int, stale_s: int = 300) -> DataFrame:
    """Last event and age per source; stale at `stale_s` seconds."""
    age = (F.lit(now_us) - F.col("last_event")) / SECOND
    return (events.groupBy(source).agg(F.max("us").alias("last_event"))
            .withColumn("age_seconds", F.round(age, 1)).withColumn("stale", age >= stale_s))


def feed_freshness(load_log: DataFrame, now_us: int, refresh_hours: int = 24,
                   multiplier: float = 2.0) -> DataFrame:
    """Age of the last successful load per feed; stale at `multiplier` refresh intervals.

    `load_log` has (feed, us, ok, error). A feed that never loaded is as old as its first attempt.
    """
    limit = max(1, refresh_hours) * 3600 * multiplier
    out = load_log.groupBy("feed").agg(
        F.max(F.when(F.col("ok"), F.col("us"))).alias("last_success"), F.min("us").alias("_first"),
        F.max_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col("us"))).alias("last_error"))
    age = (F.lit(now_us) - F.coalesce("last_success", "_first")) / SECOND
    return (out.withColumn("age_seconds", F.round(age, 1)).withColumn("stale", age >= limit)
            .drop("_first"))
