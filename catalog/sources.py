"""Ingest: lines are rendered from the projections and parsed back."""

from pyspark.sql import functions as F

from lanwatch.operators import volume
from lanwatch.sources import events, lines

from .base import US_HOUR, Tables, duck


def _lines(df, text, order="event_id"):
    return df.select("event_id", "us", F.expr(text).alias("value"), F.col(order).alias("line_no"))


_FLOW = ("event_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "flags", "size")


def _conntrack(spark, d):
    t = Tables(spark, d)
    rows = _lines(t.conn, """case when event_id % 17 = 0 then 'conntrack v1.4.6: 5 flow entries'
      when event_id % 5 = 0 then format_string('icmp 1 29 src=%s dst=%s type=8', src_ip, dst_ip)
      else format_string('ipv4 2 %s 6 299 ESTABLISHED src=%s dst=%s sport=%d dport=%d src=%s dst=%s sport=%d dport=1',
        protocol, src_ip, dst_ip, 20000 + event_id % 1000, dst_port, dst_ip, src_ip, dst_port) end""")
    return lines.ingest_conntrack(rows).select(*_FLOW)


_CONNTRACK = duck("""select event_id, src_ip, case when event_id % 5 = 0 then 0 else 20000 + event_id % 1000 end::int src_port,
 dst_ip, case when event_id % 5 = 0 then 0 else dst_port end::int dst_port, case when event_id % 5 = 0 then 'icmp' else protocol end protocol,
 '' flags, 0::bigint size from conn where event_id % 17 != 0""", "conn")


def _filterlog(spark, d):
    t = Tables(spark, d)
    rows = _lines(t.conn, """case when event_id % 13 = 0 then 'sshd[1]: nothing here'
      when event_id % 4 = 0 then format_string('Jan  3 pf filterlog[77]: 100,,,1,igb1,match,block,in,6,0x00,0x0,64,%s,17,53,fe80::%d,fe80::2,%d,%d',
        upper(protocol), event_id % 9 + 1, 5000 + event_id % 100, dst_port)
      when event_id % 3 = 0 then format_string('100,,,1,igb1,match,pass,out,4,0x0,,64,1,0,DF,1,icmp,84,%s,%s,request,1', src_ip, dst_ip)
      else format_string('<134>filterlog[77]: 100,,,1,igb1,match,pass,out,4,0x0,,64,1,0,DF,6,%s,60,%s,%s,%d,%d,0,S', protocol, src_ip, dst_ip,
        5000 + event_id % 100, dst_port) end""")
    return lines.ingest_filterlog(rows).select(*_FLOW)


_FILTERLOG = duck("""select event_id, case when six then concat('fe80::', event_id % 9 + 1) else src_ip end src_ip,
 case when icmp then 0 else 5000 + event_id % 100 end::int src_port, case when six then 'fe80::2' else dst_ip end dst_ip,
 case when icmp then 0 else dst_port end::int dst_port, case when icmp then 'icmp' else protocol end protocol, '' flags, 0::bigint size
 from (select *, event_id % 4 = 0 six, event_id % 4 != 0 and event_id % 3 = 0 icmp from conn where event_id % 13 != 0)""", "conn")


def _flow_export(spark, d):
    t = Tables(spark, d)
    rows = t.conn.select("event_id", F.expr("element_at(array(1, 6, 17, 47), cast(event_id % 4 as int) + 1)").alias("protocol_number"),
                         F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("src_ip")).alias("src_ip"),
                         F.col("dst_port").alias("src_port"), "dst_ip", "dst_port", "size")
    return lines.ingest_flow_export(rows).select(*_FLOW)


_FLOW_EXPORT = duck("""select event_id, src_ip, dst_port src_port, dst_ip, dst_port,
 case event_id % 4 when 0 then 'icmp' when 1 then 'tcp' when 2 then 'udp' else '47' end protocol, '' flags, size
 from conn where event_id % 11 != 0""", "conn")


def _snapshot_diff(spark, d):
    t = Tables(spark, d)
    keys = ["local_ip", "remote_ip", "remote_port"]
    return events.new_in_snapshot(t.sockets.where("state = 'ESTABLISHED'").select("us", *keys), keys, "us")


_SNAPSHOT_DIFF = duck("""select us, local_ip, remote_ip, remote_port from (
 select *, lag(no) over (partition by local_ip, remote_ip, remote_port order by no) last from (
  select distinct us, local_ip, remote_ip, remote_port, dense_rank() over (order by us) no from sockets where state = 'ESTABLISHED'))
 where no > 1 and (last is null or last != no - 1)""", "sockets")


def _auth_log(spark, d):
    t = Tables(spark, d)
    rows = _lines(t.auth, """concat(date_format(timestamp_micros(us), 'MMM dd HH:mm:ss'), ' host ', case event_kind
      when 'ssh_failure' then case when event_id % 2 = 0 then format_string('sshd[9]: Failed password for invalid user %s from %s port 22', usr, src_ip)
         else format_string('sshd[9]: Invalid user %s from %s', usr, src_ip) end
      when 'ssh_success' then format_string('sshd[9]: Accepted publickey for %s from %s port 22', usr, src_ip)
      when 'sudo' then format_string('sudo: %s : TTY=pts/0 ; COMMAND=%s', usr, command)
      when 'sudo_failure' then 'sudo: pam_unix(sudo:auth): authentication failure; user=x'
      else case when event_id % 3 = 0 then 'cron[1]: job' else format_string('useradd[3]: new user: name=%s', usr) end end)""")
    return lines.ingest_auth_log(rows.select("event_id", "value"), 2024).drop("line")


_AUTH_LOG = duck("""select event_id, us - us % 1000000 as us, event_kind, case when event_kind not in ('sudo', 'sudo_failure') then usr end usr,
 case when event_kind like 'ssh%' then src_ip end src_ip, case when event_kind = 'sudo' then command end command
 from auth where not (event_kind = 'new_user' and event_id % 3 = 0)""", "auth")


def _indicator_load(spark, d):
    t = Tables(spark, d)
    ips = _lines(t.dns, """case when event_id % 7 = 0 then '# note' when event_id % 9 = 0 then '  '
      else concat(response_ip, '  seen') end""")
    nets = _lines(t.dns, """case when event_id % 700 = 1 then '; note' when event_id % 300 = 1 then 'bad/77 ; x'
      else concat(response_ip, '/', 20 + event_id % 9, ' ; SBL', event_id) end""")
    urls = t.table("pages").select(F.col("url").alias("value"), F.col("page_id").alias("line_no"))
    hosts = _lines(t.dns, "concat('http://', response_ip, ':8080/x')").select("value", "line_no")
    out = lines.build_indicators([("feodo", ips), ("nobody", ips), ("spamhaus_drop", nets),
                                  ("urlhaus", urls.unionByName(hosts))])
    return out.select("value", "kind", "source", "category", F.col("feed_order.line").alias("line"))


_INDICATOR_LOAD = duck("""select response_ip as "value", 'ip' kind, 'urlhaus' source, 'malware_distribution' category, max(event_id) line from dns group by 1
 union all select h, 'domain', 'urlhaus', 'malware_distribution', max(page_id) from (select page_id,
   lower(trim(regexp_extract(url, '^(?:[^:]*://)?(?:[^/@]*@)?([^/:]*)', 1))) h from pages) where h != '' group by 1
 union all select concat(response_ip, '/', 20 + event_id % 9), 'cidr', 'spamhaus_drop', 'hijacked_netblock', event_id from dns
   where event_id % 700 != 1 and event_id % 300 != 1""", "dns")


def _leases(spark, d):
    t = Tables(spark, d)
    mac = "upper(replace(src_mac, ':', '-'))"
    plain = _lines(t.arp, f"""case when event_id % 10 = 0 then concat('1 ', {mac}) else concat('1700 ', {mac}, ' ', src_ip, ' ',
      case when event_id % 3 = 0 then '*' else concat('host', event_id) end, ' 01') end""")
    blocks = _lines(t.arp, f"""concat('lease ', src_ip, ' {{\\n  starts 1;\\n', case when event_id % 10 = 0 then '' else concat('  hardware ethernet ',
      src_mac, ';\\n') end, case when event_id % 3 = 0 then '' else concat('  client-hostname "host', event_id, '";\\n') end)""".replace("{{", "{"))
    return (lines.ingest_dhcp(plain).withColumn("format", F.lit("dnsmasq"))
            .unionByName(lines.ingest_dhcp(blocks, "isc").withColumn("format", F.lit("isc"))))


_LEASES = duck("""select src_mac mac, max_by(src_ip, event_id) ip, max_by(case when event_id % 3 = 0 then '' else concat('host', event_id) end, event_id) hostname,
 f as format from arp, (values ('dnsmasq'), ('isc')) x(f) where event_id % 10 != 0 group by src_mac, f""", "arp")


def _sensor_alerts(spark, d):
    t = Tables(spark, d)
    alert = F.struct(
        "alert_id", F.when(F.col("us") % 5 == 0, "yesterday").otherwise(
            F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).alias("timestamp"),
        F.when(F.col("us") % 7 == 0, "severe").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("us") % 11 == 0, "odd").otherwise(F.col("category")).alias("category"),
        "affected_host", "related_host", "title", (F.col("confidence") - 0.5).alias("confidence"),
        F.when(F.col("us") % 3 == 0, "").otherwise(F.col("dedup_key")).alias("dedup_key"),
        F.from_json("extra", "src_ip string").alias("extra"))
    message = F.when(F.col("us") % 13 == 0, '{"sensor_id": "x"}').otherwise(F.to_json(F.struct(
        F.when(F.col("us") % 2 == 0, F.col("sensor")).otherwise("").alias("sensor_id"), alert.alias("alert"))))
    rows = t.raised.select("us", message.alias("value"))
    out = lines.ingest_sensor_alerts(rows, F.lit(99).cast("bigint"))
    return out.select("alert_id", "us", "severity", "category", "affected_host", "related_host", "title",
                      F.round("confidence", 6).alias("confidence"), "dedup_key", "sensor",
                      F.get_json_object("extra", "$.src_ip").alias("src_ip"))


_SENSOR_ALERTS = duck("""select alert_id, case when us % 5 = 0 then 99 else us end us, case when us % 7 = 0 then 'info' else severity end severity,
 c category, affected_host, related_host, title, round(case when confidence = 0.5 then 1.0 else confidence - 0.5 end, 6)::double confidence,
 case when us % 3 = 0 then concat(c, ':', affected_host, ':', title) else dedup_key end dedup_key,
 case when us % 2 = 0 then coalesce(sensor, 'unknown') else 'unknown' end sensor, json_extract_string(extra, '$.src_ip') src_ip
 from (select *, case when us % 11 = 0 then 'system' else category end c from raised) where us % 13 != 0""", "raised")


def _normalised(spark, d):
    t = Tables(spark, d)
    raw = t.dns.withColumn("query_name", F.concat(F.lit("."), F.upper(F.when(F.col("event_id") % 6 == 0, "a.b").otherwise(
        F.col("query_name"))), F.lit("."))).withColumn("query_type", F.when(F.col("event_id") % 2 == 0, F.expr(
            "string(element_at(array(1, 28, 15, 16, 2, 5, 12, 99), int(event_id % 8) + 1))")).otherwise(F.col("query_type")))
    return events.normalise_dns(raw).select("event_id", "query_name", "query_type")


_NORMALISED = duck("""select event_id, query_name, case when event_id % 2 = 0 then
 case event_id % 8 when 0 then 'A' when 2 then 'MX' when 4 then 'NS' else 'PTR' end else query_type end query_type
 from dns where event_id % 6 != 0""", "dns")


def _arp_snapshot(spark, d):
    t = Tables(spark, d)
    snap = t.arp.select("event_id", "us", F.col("src_ip").alias("ip"), F.when(
        F.col("event_id") % 4 == 0, "00:00:00:00:00:00").otherwise(F.upper("src_mac")).alias("mac"))
    return events.arp_from_snapshot(snap).select("event_id", "us", "op", "src_ip", "src_mac", "dst_ip")


_ARP_SNAPSHOT = duck("select event_id, us, op::int op, src_ip, src_mac, '0.0.0.0' dst_ip from arp where event_id % 4 != 0", "arp")


def _iface_rate(spark, d):
    out = volume.iface_rate(Tables(spark, d).counters)
    return out.withColumn("bytes_per_minute", F.round("bytes_per_minute", 4))


_IFACE_RATE = duck("""select name, us, round(case when t >= p then t - p else t end / ((us - q) / 60000000.0), 4)::double bytes_per_minute from (
 select *, lag(t) over w p, lag(us) over w q from (select *, rx_bytes + tx_bytes t from counters) window w as (partition by name order by us))
 where p is not null""", "counters")

ENTRIES = {
    "ingest_conntrack": (_conntrack, _CONNTRACK), "ingest_filterlog": (_filterlog, _FILTERLOG),
    "ingest_flow_export": (_flow_export, _FLOW_EXPORT), "snapshot_diff": (_snapshot_diff, _SNAPSHOT_DIFF),
    "ingest_auth_log": (_auth_log, _AUTH_LOG), "indicator_load": (_indicator_load, _INDICATOR_LOAD),
    "dhcp_leases": (_leases, _LEASES), "sensor_alerts": (_sensor_alerts, _SENSOR_ALERTS),
    "normalise_dns": (_normalised, _NORMALISED), "arp_snapshot": (_arp_snapshot, _ARP_SNAPSHOT),
    "iface_rate": (_iface_rate, _IFACE_RATE),
}
