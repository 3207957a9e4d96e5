"""Baselines, inventory and lookups."""

from pyspark.sql import functions as F

from lanwatch.functions.alerting import severity_name, severity_rank
from lanwatch.operators import baseline, firsts, inventory, lookup, windows
from lanwatch.operators.suppress import cooldown

from .base import HOUR, Tables, duck, greedy
from .detections import CFG, LEARNED, _GEO, _INTEL_IP, _INTEL_NAME

MID = 1_705_276_800_000_000  # middle of the events' month


def _stats(spark, d):
    t = Tables(spark, d)
    keys = ["user_id"]
    a = baseline.stats_agg(t.base.where(F.col("us") < MID), keys, "value")
    b = baseline.stats_agg(t.base.where(F.col("us") >= MID), keys, "value")
    m = baseline.stats_merge(a, b, keys)
    return m.select("user_id", "n", F.round("mean", 4).alias("mean"),
                    F.round(baseline.stddev(F.col("n"), F.col("m2")), 4).alias("sd"))


_STATS = duck("""select user_id, count(*) n, round(avg(value), 4) mean, round(case when count(*) >= 2 then stddev_pop(value) else 0 end, 4) sd
 from base group by user_id""")


def _hourly(spark, d):
    out = baseline.hourly_baseline(Tables(spark, d).conn, CFG.but(poll_interval=HOUR))
    return out.withColumn("avg_conn", F.round("avg_conn", 6)).withColumn("stddev_conn", F.round("stddev_conn", 6))


_HOURLY = duck("""select src_ip ip, cast(hour(make_timestamp(us)) as int) hour_of_day, cast(isodow(make_timestamp(us)) - 1 as int) day_of_week,
 round(avg(n), 6) avg_conn, round(stddev_pop(n), 6) stddev_conn, count(*) sample_count, max(us) updated_at
 from (select src_ip, us - us % 3600000000 as us, count(*) n from conn group by 1, 2) group by 1, 2, 3""", "conn")


def _merged(t, table, keys):
    early, late = (table(F.col("us") < MID), table(F.col("us") >= MID))
    return baseline.merge_baseline(early, late, keys)


def _destinations(spark, d):
    t = Tables(spark, d)
    return _merged(t, lambda w: baseline.destination_baseline(t.conn.where(w)), ["src_ip", "dst_ip", "dst_port", "protocol"])


_DESTINATIONS = duck("""select src_ip, dst_ip, dst_port, protocol, count(*) hit_count, min(us) first_seen, max(us) last_seen
 from conn group by all""", "conn")


def _domains(spark, d):
    t = Tables(spark, d)
    return _merged(t, lambda w: baseline.dns_baseline(t.dns.where(w), CFG), ["domain"])


_DOMAINS = duck("""select query_name as "domain", count(*) query_count, min(us) first_seen, max(us) last_seen from dns group by 1""", "dns")


def _host_sets(spark, d):
    t = Tables(spark, d)
    c = baseline.host_countries(t.conn, t.prefixes, CFG).select(
        F.col("src_ip").alias("ip"), F.lit("country").alias("dimension"), F.col("country").alias("value"), "first_seen")
    h = baseline.host_hours(t.conn, CFG).select("ip", F.lit("hour").alias("dimension"), F.col("hour").cast("string").alias("value"), "first_seen")
    return c.unionByName(h).unionByName(baseline.host_profile(t.conn, CFG))


_HOST_SETS = duck("""select ip, dimension, v as "value", min(us) first_seen from (
 select src_ip ip, 'country' dimension, country v, us from conn join geo on geo.ip = dst_ip
 union all select src_ip, 'hour', cast(hour(make_timestamp(us)) as varchar), us from conn
 union all select src_ip, 'dst_port', cast(dst_port as varchar), us from conn
 union all select src_ip, 'peer', dst_ip, us from conn where dst_ip like '192.168.1.%' and dst_ip != src_ip
 union all select src_ip, 'protocol', protocol, us from conn
 union all select src_ip, 'byte_range', case when size < 1000 then '0-1K' when size < 10000 then '1K-10K' when size < 100000 then '10K-100K'
   when size < 1000000 then '100K-1M' when size < 10000000 then '1M-10M' else '10M+' end, us from conn where size > 0) group by all""", "conn",
                  geo=_GEO.format(col="dst_ip", src="conn"))


def _summary(spark, d):
    t = Tables(spark, d)
    return baseline.baseline_summary(baseline.dns_baseline(t.dns, CFG), baseline.destination_baseline(t.conn),
                                     baseline.hourly_baseline(t.conn, CFG), t.sockets.where("state = 'LISTEN'"),
                                     LEARNED - 3 * HOUR * 1_000_000, CFG)


_SUMMARY = duck("""select true is_learning, 3.0::double learning_hours_remaining, (select count(distinct query_name) from dns) known_domains,
 (select count(*) from (select distinct src_ip, dst_ip, dst_port, protocol from conn)) known_destinations,
 (select count(distinct src_ip) from conn) tracked_hosts,
 (select count(distinct local_port) from sockets where state = 'LISTEN') known_listening_ports""", "conn", "dns", "sockets")


def _known_sets(spark, d):
    ports = baseline.known_ports(Tables(spark, d).sockets)
    return ports.select(F.array_join("ports", ",").alias("ports"), F.size("ports").cast("bigint").alias("n"))


_KNOWN_SETS = duck("""select string_agg(local_port, ',' order by local_port) ports, count(*) n from (
 select distinct local_port from sockets where state = 'LISTEN')""", "sockets")


def _inventory(spark, d):
    t = Tables(spark, d)
    latest = F.max(F.when((F.col("event_id") % 3 == 0) & F.col("src_mac").like("%5"), F.col("event_id")))
    leases = t.arp.groupBy(F.col("src_mac").alias("mac")).agg(F.concat(F.lit("Living-TV"), latest % 5).alias("hostname"))
    given = t.arp.groupBy(F.col("src_ip").alias("ip")).agg(F.when(F.max("event_id") % 2 == 0, "nas.lan").otherwise("box").alias("name"))
    out = inventory.device_inventory(t.arp, CFG, leases, given)
    return out.select("ip", "mac", "first_seen", "last_seen", "hostname", "vendor", "is_gateway", "is_trusted", "identity_source",
                      "device_type", "device_type_confidence")


_INVENTORY = duck("""select ip, now mac, first_seen, last_seen, hostname, vendor, is_gateway, is_trusted,
 case when lease is not null then 'dhcp' else 'reverse_dns' end identity_source,
 case when is_gateway then 'router' when lease is not null then 'tv' when hostname = 'nas.lan' then 'nas'
   when vendor != '' then 'single_board_computer' else 'unknown' end device_type,
 case when is_gateway then 0.95 when lease is not null or hostname = 'nas.lan' then 0.85 when vendor != '' then 0.9 else 0 end::double device_type_confidence
 from (select d.*, lease, coalesce(lease, given) hostname, case when d.mac like 'b8:27%' then 'Raspberry Pi Foundation' else '' end vendor,
   d.ip = '192.168.1.1' or d.mac = 'b8:27:eb:00:00:10' is_gateway, d.ip = '192.168.1.3' or d.mac = 'b8:27:eb:00:00:15' is_trusted
  from d left join leases l on l.mac = d.mac)""", "arp",
                  d="""select src_ip ip, min_by(src_mac, us) mac, max_by(src_mac, us) now, min(us) first_seen, max(us) last_seen,
   case when max(event_id) % 2 = 0 then 'nas.lan' else 'box' end given from arp group by 1""",
                  leases="""select src_mac mac, concat('Living-TV', max(event_id) % 5) lease from arp where event_id % 3 = 0 and src_mac like '%5' group by 1""")


def _geo(spark, d):
    t = Tables(spark, d)
    out = lookup.asn_lookup(lookup.geo_lookup(t.conn.select("event_id", "dst_ip"), "dst_ip", t.prefixes), "dst_ip", t.prefixes)
    return out.select("event_id", "dst_ip", "country", "country_name", "asn", "org")


_GEO_SQL = duck("""select event_id, dst_ip, coalesce(country, '') country, coalesce(country_name, '') country_name,
 case when o is null then 0 when o between 4 and 7 then 64501 when o < 16 then 64500 when o < 32 then 64502 when o < 48 then 64503 else 0 end::bigint asn,
 case when o is null then '' when o between 4 and 7 then 'Bulletproof Hosting BV' when o < 16 then 'Alpha Net' when o < 32 then 'Gamma' else '' end org
 from (select *, case when dst_ip like '203.%' then cast(split_part(dst_ip, '.', 4) as int) end o from conn) left join geo on geo.ip = dst_ip""", "conn",
                geo=_GEO.format(col="dst_ip", src="conn"))


def _indicators(spark, d):
    t = Tables(spark, d)
    by_ip = lookup.match_ip(t.dns.select("event_id", "query_name", "response_ip"), "response_ip", t.indicators, "ip_hit")
    both = lookup.match_domain(by_ip, "query_name", t.indicators, "name_hit")
    return both.select("event_id", F.col("ip_hit.value").alias("ip_value"), F.col("ip_hit.source").alias("ip_source"),
                       F.col("name_hit.value").alias("name_value"), F.col("name_hit.category").alias("name_category"))


_INDICATORS = duck(f"""select event_id, ip_value, i.source ip_source, name_value, n.category name_category from (
 select *, {_INTEL_IP.format(ip='response_ip')} ip_value, {_INTEL_NAME.format(n='query_name')} name_value from dns)
 left join indicators i on i.value = ip_value left join indicators n on n.value = name_value""", "dns")


def _membership(spark, d):
    t = Tables(spark, d)
    keys = ["src_ip", "dst_ip", "dst_port"]
    known = t.conn.where(F.col("us") < MID)
    flagged = firsts.known_in_baseline(t.conn.where(F.col("us") >= MID).select("event_id", *keys), known, keys)
    fresh = firsts.not_in_baseline(t.conn.where(F.col("us") >= MID).select("event_id", *keys), known, keys)
    named = lookup.with_hostname(flagged, t.conn.groupBy(F.col("dst_ip").alias("ip")).agg(
        F.when(F.col("dst_ip").like("%7"), F.max("sensor")).alias("hostname")), "dst_ip")
    return named.select("event_id", "known", "hostname", F.lit(False).alias("fresh")).unionByName(
        fresh.select("event_id", F.lit(False).alias("known"), F.lit("").alias("hostname"), F.lit(True).alias("fresh")))


_MEMBERSHIP = duck(f"""select event_id, known, coalesce(hostname, '') hostname, false fresh from late left join (
  select dst_ip, max(sensor) hostname from conn where dst_ip like '%7' group by 1) using (dst_ip)
 union all select event_id, false, '', true from late where not known""", "conn",
                   late=f"""select *, exists (select 1 from conn e where e.us < {MID} and e.src_ip = c.src_ip and e.dst_ip = c.dst_ip
   and e.dst_port = c.dst_port) known from conn c where us >= {MID}""")


def _windows(spark, d):
    t = Tables(spark, d)
    rows = windows.sliding_distinct(t.conn.select("event_id", "us", "src_ip", "dst_ip", "dst_port"), ["src_ip"],
                                    ["dst_ip", "dst_port"], 6 * HOUR * 1_000_000, ["hosts", "ports"], count_out="n")
    return rows.select("event_id", "hosts", "ports", "n")


_W = "over (partition by src_ip order by us range between 21599999999 preceding and current row)"
_WINDOWS = duck(f"select event_id, count(distinct dst_ip) {_W} hosts, count(distinct dst_port) {_W} ports, count(*) {_W} n from conn", "conn")


def _cooldowns(spark, d):
    t = Tables(spark, d)
    return cooldown(t.dns.select("event_id", "us", "src_ip"), "src_ip", HOUR).select("us", "src_ip")


_COOLDOWNS = duck("select us, src_ip from kept", "dns", kept=greedy("dns", "src_ip", HOUR))


def _severity_peak(spark, d):
    a = Tables(spark, d).raised.groupBy("affected_host").agg(F.max(severity_rank(F.col("severity"))).alias("r"))
    return a.select("affected_host", severity_name(F.col("r")).alias("peak"))


_SEVERITY_PEAK = duck("""select affected_host, ['info','low','medium','high','critical'][max(list_position(['info','low','medium','high','critical'], severity))] peak
 from raised group by 1""", "raised")

ENTRIES = {
    "running_stats_merge": (_stats, _STATS), "hourly_baseline": (_hourly, _HOURLY),
    "destination_baseline": (_destinations, _DESTINATIONS), "dns_baseline": (_domains, _DOMAINS),
    "host_sets": (_host_sets, _HOST_SETS), "baseline_summary": (_summary, _SUMMARY), "known_ports": (_known_sets, _KNOWN_SETS),
    "device_inventory": (_inventory, _INVENTORY), "geo_asn_lookup": (_geo, _GEO_SQL), "indicator_match": (_indicators, _INDICATORS),
    "baseline_membership": (_membership, _MEMBERSHIP), "sliding_counts": (_windows, _WINDOWS), "cooldown": (_cooldowns, _COOLDOWNS),
    "severity_peak": (_severity_peak, _SEVERITY_PEAK),
}
