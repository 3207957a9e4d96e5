"""Scalar functions over whole columns."""

from pyspark.sql import functions as F

from lanwatch.functions import alerting, moments, names, net, tables

from .base import Tables, duck


def _addresses(spark, d):
    t = Tables(spark, d)
    ip = F.col("dst_ip")
    return t.conn.select(
        "event_id", net.is_private_ip(ip).alias("private"), net.is_valid_ip(ip).alias("valid"),
        net.is_valid_ip(F.concat(ip, F.lit(".1"))).alias("valid_long"), net.ip_to_long(ip).alias("ip_n"),
        net.ip_in_subnets(ip, ["192.168.1.16/28", "203.0.113.8/29"]).alias("inside"),
        net.ip_hex(ip).alias("ip_hex"))


_N = ("cast(split_part(dst_ip,'.',1) as bigint)*16777216+cast(split_part(dst_ip,'.',2) as bigint)*65536"
      "+cast(split_part(dst_ip,'.',3) as bigint)*256+cast(split_part(dst_ip,'.',4) as bigint)")
_ADDRESSES = duck(f"""select event_id, dst_ip like '192.168.%' private, true valid, false valid_long, {_N} ip_n,
 ({_N} between 3232235792 and 3232235807) or ({_N} between 3405803784 and 3405803791) inside,
 lower(lpad(to_hex({_N}), 8, '0')) ip_hex from conn""", "conn")


def _macs(spark, d):
    t = Tables(spark, d)
    raw = F.upper(F.replace("src_mac", F.lit(":"), F.lit("-")))
    return t.arp.select("event_id", net.normalize_mac(raw).alias("mac"), net.mac_vendor(raw).alias("vendor"),
                        net.normalize_mac(F.concat(raw, F.lit("A"))).alias("odd"))


_MACS = duck("""select event_id, src_mac mac,
 case when src_mac like 'b8:27:eb%' then 'Raspberry Pi Foundation' else '' end vendor,
 lower(concat(replace(src_mac, ':', '-'), 'A')) odd from arp""", "arp")


def _names(spark, d):
    t = Tables(spark, d)
    n = F.col("query_name")
    return t.dns.select(
        "event_id", F.round(names.label_entropy(n), 6).alias("entropy"),
        names.label_count(n).cast("bigint").alias("dots"), names.suspicious_tld(n).alias("odd_tld"),
        names.domain_in_list(n, ["example.net", "bad.xyz"]).alias("listed"),
        names.on_cdn(F.concat(F.lit("x."), F.replace(n, F.lit("example.com"), F.lit("acloudfront.net")))).alias("cdn"),
        F.array_join(names.domain_suffixes(n), ",").alias("suffixes"))


_NAMES = duck("""select d.event_id, e.entropy, length(query_name) - length(replace(query_name, '.', '')) dots,
 query_name like '%.xyz' odd_tld, query_name like '%.example.net' or query_name like '%.bad.xyz' listed,
 query_name like '%example.com' cdn,
 array_to_string(list_transform(range(1, len(string_split(query_name, '.'))),
   lambda i: array_to_string(list_slice(string_split(query_name, '.'), i, 99), '.')), ',') suffixes
 from dns d join (select event_id, round(-sum(p * log2(p)), 6) entropy from (
   select event_id, count(*) / max(length(lab)) p from (
     select event_id, split_part(query_name, '.', 1) lab, unnest(string_split(split_part(query_name, '.', 1), '')) ch
     from dns) group by event_id, ch) group by event_id) e using (event_id)""", "dns")


def _url_hosts(spark, d):
    t = Tables(spark, d)
    host = names.url_host(F.col("url"))
    return t.table("pages").select("page_id", host.alias("host"), net.is_valid_ip(host).alias("is_ip"),
                                   names.suspicious_tld(host).alias("odd_tld"))


_URL_HOSTS = """select page_id, h host, regexp_full_match(h, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') is_ip,
 contains(h, '.') and list_contains(['tk','ml','ga','cf','gq','xyz','top','click','online','site','info','biz','pw','cc','ws'],
   list_last(string_split(h, '.'))) odd_tld
 from (select page_id, lower(trim(regexp_extract(url, '^(?:[^:]*://)?(?:[^/@]*@)?([^/:]*)', 1))) h from pages)"""


def _ports_and_sizes(spark, d):
    t = Tables(spark, d)
    p, ip = F.col("dst_port"), F.col("dst_ip")
    resolver = F.when(F.col("size") % 3 == 0, "9.9.9.9").when(F.col("size") % 3 == 1, "1.0.0.1").otherwise(ip)
    return t.conn.select("event_id", net.byte_bucket(F.col("size")).alias("bucket"),
                         net.port_service(p).alias("service"), net.admin_protocol(p).alias("admin"),
                         net.resolver_provider(resolver).alias("provider"))


_PORTS = duck("""select event_id, case when size < 1000 then '0-1K' when size < 10000 then '1K-10K'
  when size < 100000 then '10K-100K' when size < 1000000 then '100K-1M' when size < 10000000 then '1M-10M' else '10M+' end bucket,
 case dst_port when 22 then 'SSH' when 445 then 'SMB' when 443 then 'HTTPS' when 853 then 'DoT' else '' end service,
 case dst_port when 22 then 'SSH' when 445 then 'SMB' end admin,
 case size % 3 when 0 then 'Quad9' when 1 then 'Cloudflare' end provider from conn""", "conn")


def _moments(spark, d):
    t = Tables(spark, d)
    us = F.col("us")
    return t.base.select(
        "event_id", moments.hour_of_day(us).alias("hour"), moments.weekday(us).alias("day"),
        moments.in_quiet_hours(us, 23, 7).alias("quiet"), moments.in_quiet_hours(us, 9, 17, "America/New_York").alias("office"),
        F.round(moments.z_score(F.col("value"), F.lit(20.0), F.lit(4.0)), 6).alias("z"),
        moments.z_score(F.col("value"), F.lit(20.0), F.lit(0.0)).alias("z_flat"))


_MOMENTS = duck("""select event_id, cast(hour(make_timestamp(us)) as int) as hour, cast(isodow(make_timestamp(us)) - 1 as int) as day,
 hour(make_timestamp(us)) >= 23 or hour(make_timestamp(us)) < 7 quiet,
 hour(make_timestamp(us - 18000000000)) between 9 and 16 office,
 round((value - 20) / 4, 6) z, abs(value - 20) z_flat from base""")


def _alert_fields(spark, d):
    t = Tables(spark, d)
    a = t.raised
    c = F.col
    e = alerting.source_destination(c("category"), c("affected_host"), c("affected_mac"), c("related_host"))
    why = alerting.explain(alerting.evidence("k", c("description"), F.lit(3.5), ">="), basis="fixed")
    return a.select(
        "alert_id", alerting.severity_rank(c("severity")).alias("sev"),
        alerting.at_least(c("severity"), "high").alias("serious"),
        alerting.default_dedup_key(F.when(c("severity") == "low", "").otherwise(c("dedup_key")),
                                   c("category"), c("affected_host"), c("title")).alias("key"),
        e["ip"].alias("src"), e["mac"].alias("mac"), e["dest"].alias("dst"), F.to_json(why).alias("why"))


_ALERT_FIELDS = duck("""select alert_id, list_position(['info','low','medium','high','critical'], severity) - 1 sev,
 severity in ('high','critical') serious,
 case when severity = 'low' then concat(category, ':', affected_host, ':', title) else dedup_key end as key,
 case when sw then related_host else affected_host end src, case when sw then '' else affected_mac end mac,
 case when sw then affected_host else related_host end dst,
 concat('{"evidence":[{"metric":"k","observed":"', description, '","threshold":3.5,"comparison":">="}],"confidence_basis":"fixed"}') why
 from (select *, category in ('port_scan','lateral_movement') and related_host != '' sw from raised)""", "raised")

ENTRIES = {
    "scalar_addresses": (_addresses, _ADDRESSES),
    "scalar_macs": (_macs, _MACS),
    "scalar_names": (_names, _NAMES),
    "scalar_url_hosts": (_url_hosts, _URL_HOSTS),
    "scalar_ports_sizes": (_ports_and_sizes, _PORTS),
    "scalar_moments": (_moments, _MOMENTS),
    "scalar_alert_fields": (_alert_fields, _ALERT_FIELDS),
}
