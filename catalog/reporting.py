"""Reports and rollups."""

from pyspark.sql import functions as F

from lanwatch.operators import baseline
from lanwatch.plans import alerts as plans, reports, scores

from .alerting import _POINTS, _devices, _points
from .base import Tables, duck
from .detections import CFG, START

NOW = START + 10 * 3600 * 1_000_000
_DST = "select src_ip, dst_ip, dst_port, protocol, count(*) hit_count, min(us) first_seen, max(us) last_seen from conn group by all"


def _severity(spark, d):
    return reports.alerts_by_severity(Tables(spark, d).raised, NOW)


_SEVERITY = duck(f"select severity, count(*) cnt from raised where us >= {NOW} group by 1", "raised")


def _sensors(spark, d):
    return reports.sensor_rollup(Tables(spark, d).raised, START + 1)


_SENSORS = duck(f"""select coalesce(sensor, 'local') sensor, count(*) alert_count, max(us) last_seen from raised where us >= {START + 1} group by 1""", "raised")


def _top(spark, d):
    t = Tables(spark, d)
    hosts = reports.top_suspicious(scores.score_devices(_devices(t), _points(t)), 5)
    names = reports.top_domains(baseline.dns_baseline(t.dns, CFG), 20)
    return hosts.select(F.lit("host").alias("list"), F.col("ip").alias("name"), F.col("alert_count").alias("value")).unionByName(
        names.select(F.lit("domain").alias("list"), F.col("domain").alias("name"), F.col("query_count").alias("value")))


_TOP = duck("""(select 'host' list, ip as "name", max(alert_count) as "value" from points group by ip order by max(score) desc, max(alert_count) desc, ip limit 5)
 union all (select 'domain', query_name, count(*) from dns group by 1, 2 order by 3 desc, 2 limit 20)""", "raised", "dns", points=_POINTS)


def _ports(spark, d):
    return reports.port_rollup(baseline.destination_baseline(Tables(spark, d).conn), 5).withColumn("rank", F.col("rank").cast("bigint"))


_PORTS = duck("""select *, case dst_port when 22 then 'SSH' when 445 then 'SMB' when 443 then 'HTTPS' when 853 then 'DoT' else '' end service from (
 select *, row_number() over (partition by src_ip order by connections desc, destinations desc, dst_port, protocol) as rank from (
 select src_ip, dst_port, protocol, count(distinct dst_ip) destinations, sum(hit_count)::bigint connections, max(last_seen) last_seen from dst group by 1, 2, 3))
 where rank <= 5""", "conn", dst=_DST)


def _destinations(spark, d):
    return reports.top_destinations(baseline.destination_baseline(Tables(spark, d).conn), 8)


_DESTINATIONS = duck("""select *, row_number() over (partition by src_ip order by hit_count desc, last_seen desc, dst_ip) as rank from dst qualify rank <= 8""",
                     "conn", dst=_DST)


def _dns(spark, d):
    return reports.dns_summary(Tables(spark, d).dns, 10)


_DNS = duck("""select *, row_number() over (partition by src_ip order by last_seen desc, query_name) as rank from (
 select src_ip, query_name, query_type, count(*) query_count, count(*) filter (is_nxdomain) nxdomain_count, max(us) last_seen from dns group by 1, 2, 3)
 qualify rank <= 10""", "dns")


def _daily(spark, d):
    t = Tables(spark, d)
    return reports.daily_report(t.raised, _devices(t), NOW)


_DAILY = duck(f"""select 'total_alerts' section, '' as "name", count(*) as "value" from raised where us <= {NOW}
 union all select 'alerts_by_severity', severity, count(*) from raised where us <= {NOW} group by 2
 union all select 'alerts_by_category', category, count(*) from raised where us <= {NOW} group by 2
 union all (select 'top_alerting_hosts', affected_host, count(*) from raised where us <= {NOW} group by 2 order by 3 desc, 2 limit 10)
 union all select 'new_devices', ip, 1 from devs union all select 'total_known_devices', '', count(*) from devs""", "raised", "arp",
              devs="""select distinct concat('192.168.1.', cast(split_part(src_ip, '.', 4) as int) + 9) ip from arp where src_ip != '192.168.1.4'""")


def _detail(spark, d):
    t = Tables(spark, d)
    conn = t.conn
    out = reports.host_detail(_devices(t), t.raised, baseline.destination_baseline(conn), t.dns, baseline.host_profile(conn, CFG),
                              baseline.host_hours(conn, CFG), baseline.host_countries(conn, t.prefixes, CFG), scores.history(_points(t)), START,
                              max_alerts=100, max_points=500, max_actions=200)
    return out.select("ip", F.size("recent_alerts").cast("bigint").alias("alerts"), F.col("recent_alerts")[0]["alert_id"].alias("newest"),
                      F.array_join(F.col("known_destinations.dst_ip"), ",").alias("destinations"),
                      F.array_join(F.col("dns_history.query_name"), ",").alias("names"),
                      F.array_join("destination_ports", ",").alias("ports"), F.array_join("internal_peers", ",").alias("peers"),
                      F.array_join("active_hours", ",").alias("hours"), F.array_join("countries", ",").alias("countries"),
                      F.size("port_rollup").cast("bigint").alias("services"), F.size("suspicion_trend").cast("bigint").alias("trend"))


_DETAIL = duck("""select ip, (select least(100, count(*)) from raised where affected_host = ip) as "alerts",
 (select arg_max(alert_id, us) from raised where affected_host = ip) as "newest",
 (select string_agg(dst_ip, ',' order by hit_count desc, last_seen desc, dst_ip) from (select * from dst where src_ip = ip order by hit_count desc, last_seen desc, dst_ip limit 25)) as "destinations",
 (select string_agg(query_name, ',' order by l desc, query_name) from (select query_name, query_type, max(us) l from dns where src_ip = ip group by 1, 2 order by l desc, 1 limit 25)) as "names",
 (select string_agg(p, ',' order by p) from (select distinct dst_port p from conn where src_ip = ip)) as "ports",
 (select string_agg(p, ',' order by p) from (select distinct dst_ip p from conn where src_ip = ip and dst_ip like '192.168.1.%' and dst_ip != ip)) as "peers",
 (select string_agg(p, ',' order by p) from (select distinct hour(make_timestamp(us)) p from conn where src_ip = ip)) as "hours",
 (select string_agg(p, ',' order by p) from (select distinct case when o between 4 and 7 then 'NL' when o < 16 then 'US' when o < 32 then 'DE' end p from (
   select cast(split_part(dst_ip, '.', 4) as int) o from conn where src_ip = ip and dst_ip like '203.%') where o < 32)) as "countries",
 (select least(15, count(*)) from (select distinct dst_port, protocol from conn where src_ip = ip)) as "services",
 (select least(500, count(*)) from raised where affected_host = ip) as "trend"
 from devs""", "raised", "arp", "conn", "dns", dst=_DST,
               devs="""select distinct concat('192.168.1.', cast(split_part(src_ip, '.', 4) as int) + 9) ip from arp where src_ip != '192.168.1.4'""")


def _status(spark, d):
    t = Tables(spark, d)
    base = baseline.baseline_summary(baseline.dns_baseline(t.dns, CFG), baseline.destination_baseline(t.conn),
                                     baseline.hourly_baseline(t.conn, CFG), t.sockets.where("state = 'LISTEN'"), NOW, CFG)
    stats = plans.suppression_stats(t.raised, t.raised.where("severity != 'low'"))
    return reports.status(t.raised, _devices(t), NOW, stats.drop("suppression_rate"), base.drop("is_learning"))


_STATUS = duck(f"""select concat('alerts_24h_', severity) item, count(*)::double as "value" from raised where us <= {NOW} group by 1
 union all select 'device_count', count(distinct src_ip) from arp where src_ip != '192.168.1.4'
 union all select 'total_processed', count(*) from raised union all select 'total_fired', count(*) from raised where severity != 'low'
 union all select 'total_suppressed', count(*) from raised where severity = 'low'
 union all select 'learning_hours_remaining', 38.0 union all select 'known_domains', count(distinct query_name) from dns
 union all select 'known_destinations', count(*) from (select distinct src_ip, dst_ip, dst_port, protocol from conn)
 union all select 'tracked_hosts', count(distinct src_ip) from conn
 union all select 'known_listening_ports', count(distinct local_port) from sockets where state = 'LISTEN'""", "raised", "arp", "dns", "conn", "sockets")


def _view(spark, d):
    t = Tables(spark, d)
    a = t.raised.withColumn("extra", F.concat(F.lit('{"timeline":[1],"enrichment":{"ip":"'), "related_host", F.lit('"}}')))
    return reports.alert_view(a).select("alert_id", "sensor", "confidence", "enrichment", "timeline", "explanation")


_VIEW = duck("""select alert_id, coalesce(sensor, 'local') sensor, confidence::double confidence, concat('{"ip":"', related_host, '"}') enrichment,
 '[1]' timeline, null::varchar explanation from raised""", "raised")


def _fresh(spark, d):
    t = Tables(spark, d)
    now = START + 30 * 86400 * 1_000_000 - 3600 * 1_000_000
    a = reports.source_freshness(t.conn.where(F.col("us") < now), "sensor", now, 1200)
    log = t.conn.select(
        F.col("sensor").alias("feed"), "us", (F.col("dst_port") != 443).alias("ok"), F.concat(F.lit("e"), "dst_port").alias("error"))
    b = reports.feed_freshness(log, now, 6, 1.5)
    return a.select("sensor", "last_event", "age_seconds", "stale", F.lit("").alias("last_error")).unionByName(
        b.select(F.concat(F.lit("feed-"), "feed").alias("sensor"), F.col("last_success").alias("last_event"), "age_seconds", "stale", "last_error"))


_NOW2 = START + 30 * 86400 * 1_000_000 - 3600 * 1_000_000
_FRESH = duck(f"""select sensor, max(us) last_event, round(({_NOW2} - max(us)) / 1000000, 1)::double age_seconds, ({_NOW2} - max(us)) / 1000000 >= 1200 stale, '' last_error
 from conn where us < {_NOW2} group by 1
 union all select concat('feed-', sensor), max(us) filter (dst_port != 443), round(({_NOW2} - max(us) filter (dst_port != 443)) / 1000000, 1),
 ({_NOW2} - max(us) filter (dst_port != 443)) / 1000000 >= 32400, case when bool_or(dst_port = 443) then 'e443' end from conn group by 1""", "conn")

ENTRIES = {
    "alerts_by_severity": (_severity, _SEVERITY), "sensor_rollup": (_sensors, _SENSORS), "top_hosts_domains": (_top, _TOP),
    "port_rollup": (_ports, _PORTS), "top_destinations": (_destinations, _DESTINATIONS), "dns_summary": (_dns, _DNS),
    "daily_report": (_daily, _DAILY), "host_detail": (_detail, _DETAIL), "status_rollup": (_status, _STATUS),
    "alert_view": (_view, _VIEW), "freshness": (_fresh, _FRESH),
}
