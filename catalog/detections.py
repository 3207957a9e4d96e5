"""Detections over the projected event tables. Windows are hours, as the events are sparse."""

from pyspark.sql import functions as F

from lanwatch.config import Adaptive, Config
from lanwatch.operators import arp, auth, beacon, dns, intel, profile, scan, volume

from .base import HOUR, Tables, adaptive_fold, brief, duck, greedy

_BACKOFF = Adaptive(trips_before_backoff=2, window=24 * HOUR)
START = 1_704_067_200_000_000  # first instant of the events
CFG = Config(
    gateway_ip="192.168.1.1", gateway_mac="b8:27:eb:00:00:10", adaptive=_BACKOFF,
    trusted_ips=("192.168.1.3",), trusted_macs=("b8:27:eb:00:00:15",),
    scan_window=72 * HOUR, scan_ports=3, scan_cooldown=2 * HOUR,
    sweep_window=24 * HOUR, sweep_hosts=8, sweep_cooldown=2 * HOUR,
    fanout_window=24 * HOUR, fanout_targets=5, fanout_cooldown=2 * HOUR,
    nxdomain_window=12 * HOUR, nxdomain_count=4, nxdomain_cooldown=2 * HOUR,
    dga_window=6 * HOUR, dga_domains=7, dga_cooldown=2 * HOUR, entropy_threshold=3.0,
    ssh_window=6 * HOUR, ssh_failures=6, flood_window=24 * HOUR, flood_replies=25,
    churn_window=24 * HOUR, churn_changes=5,
    beacon_intervals=5, beacon_cv=0.5, beacon_idle=720 * HOUR, beacon_cooldown=6 * HOUR,
    canary_ports=tuple(range(1000, 1010)), suspicious_asns=(64500,), asn_keywords=("gamma",),
    spike_factor=2.0, spike_z=2.0, spike_cooldown=12 * HOUR, poll_interval=6 * HOUR,
    learning_start_us=START, learning_hours=48,
    ports_min_known=40, peers_min_known=8, protocols_min_known=1, byte_ranges_min_known=1, hours_min_known=15)
LEARNED = START + 48 * HOUR * 1_000_000


def _local(c):
    return f"{c} like '192.168.1.%'"


def _over(count, part, source, window, where="true"):
    return (f"select *, {count} over (partition by {part} order by us range between "
            f"{int(window) * 1_000_000 - 1}::bigint preceding and current row) n from {source} where {where}")


def _adaptive(source_sql, host, pair, base, cd, needs, final, **more):
    ctes = {"counted": source_sql, "hits": f"select * from counted where n >= {base}"}
    ctes.update(adaptive_fold("hits", host, pair, "n", base, cd, 24 * HOUR, 2))
    ctes["fired"] = f"select h.*, f.threshold from fold f join hits h using ({host}, us) where f.fired"
    return duck(final, needs, **ctes, **more)


def _port_scan(spark, d):
    a = scan.port_scan(Tables(spark, d).conn, CFG)
    return brief(a, {"samples": ("$.sample_ports", "string"),
                     "threshold": ("$.explanation.evidence[0].threshold", "double")}, unique_ports_count="bigint")


_PORT_SCAN = _adaptive(
    _over("count(distinct dst_port)", "src_ip, dst_ip", "conn", 72 * HOUR, "protocol = 'tcp' and contains(flags, 'S')"),
    "src_ip", "dst_ip", 3, 2 * HOUR, "conn",
    """select us, case when n >= 100 then 'high' when n >= 50 then 'medium' else 'low' end severity,
 dst_ip affected_host, src_ip related_host, concat('port_scan:', src_ip, ':', dst_ip) dedup_key,
 concat('Port scan: ', src_ip, ' → ', dst_ip, ' (', n, ' ports/min)') title, 0.9::double confidence, n unique_ports_count,
 (select concat('[', string_agg(p, ',' order by p), ']') from (select distinct dst_port p from conn c where c.protocol = 'tcp'
   and contains(c.flags, 'S') and c.src_ip = f.src_ip and c.dst_ip = f.dst_ip and c.us <= f.us
   and c.us > f.us - 259200000000 order by 1 limit 10)) samples, round(threshold, 1) threshold from fired f""")


def _host_sweep(spark, d):
    return brief(scan.host_sweep(Tables(spark, d).conn, CFG), unique_hosts="bigint")


_HOST_SWEEP = _adaptive(
    _over(f"count(distinct case when {_local('dst_ip')} then dst_ip end)", "src_ip", "conn", 24 * HOUR,
          "protocol = 'tcp' and contains(flags, 'S')"),
    "src_ip", "src_ip", 8, 2 * HOUR, "conn",
    """select us, 'medium' severity, 'LAN' affected_host, src_ip related_host, concat('host_sweep:', src_ip) dedup_key,
 concat('Host sweep: ', src_ip, ' contacted ', n, ' local hosts in 86400s') title, 0.8::double confidence, n unique_hosts from fired""")


def _lateral(spark, d):
    a = scan.lateral_fanout(Tables(spark, d).conn, CFG)
    return brief(a, target_count="bigint", protocols="string")


_LATERAL = _adaptive(
    _over("count(distinct case when dst_port in (22, 445) then dst_ip end)", "src_ip", "conn", 24 * HOUR,
          f"{_local('dst_ip')} and src_ip != dst_ip"),
    "src_ip", "src_ip", 5, 2 * HOUR, "conn",
    """select us, 'high' severity, src_ip affected_host, '' related_host, concat('lateral_fanout:', src_ip) dedup_key,
 concat('Possible lateral movement: ', src_ip, ' → ', n, ' hosts via admin protocols') title, 0.8::double confidence, n target_count,
 (select concat('[', string_agg(distinct case when dst_port = 22 then '"SSH"' else '"SMB"' end, ',' order by
   case when dst_port = 22 then '"SSH"' else '"SMB"' end), ']') from conn c where c.src_ip = f.src_ip and c.src_ip != c.dst_ip
   and c.dst_port in (22, 445) and c.dst_ip like '192.168.1.%' and c.us <= f.us and c.us > f.us - 86400000000) protocols
 from fired f""")


def _nxdomain(spark, d):
    return brief(dns.nxdomain_rate(Tables(spark, d).dns, CFG), nxdomain_count="bigint", unique_domains="bigint")


_NXDOMAIN = _adaptive(
    _over("count(*)", "src_ip", "dns", 12 * HOUR, "is_nxdomain"), "src_ip", "src_ip", 4, 2 * HOUR, "dns",
    """select us, 'high' severity, src_ip affected_host, '' related_host, concat('nxdomain_rate:', src_ip) dedup_key,
 concat('High NXDOMAIN rate: ', src_ip, ' (', n, ' failures/min)') title, 0.8::double confidence, n nxdomain_count,
 (select count(distinct query_name) from dns c where c.is_nxdomain and c.src_ip = f.src_ip and c.us <= f.us
   and c.us > f.us - 43200000000) unique_domains from fired f""")


def _dga(spark, d):
    return brief(dns.dga_rate(Tables(spark, d).dns, CFG), unique_domains_per_minute="bigint")


_DGA = _adaptive(
    _over("count(distinct query_name)", "src_ip", "dns", 6 * HOUR), "src_ip", "src_ip", 7, 2 * HOUR, "dns",
    """select us, 'medium' severity, src_ip affected_host, '' related_host, concat('dga_query_rate:', src_ip) dedup_key,
 concat('High unique DNS query rate: ', src_ip, ' (', n, ' unique/min)') title, 0.7::double confidence,
 n unique_domains_per_minute from fired""")


def _ssh(spark, d):
    return brief(auth.ssh_brute_force(Tables(spark, d).auth, CFG), failure_count="bigint", last_user="string")


_SSH = duck("""select us, 'high' severity, 'localhost' affected_host, src_ip related_host, concat('ssh_brute:', src_ip) dedup_key,
 concat('SSH brute force: ', src_ip, ' (', n, ' failures in 21600s)') title, 0.95::double confidence, n failure_count, usr last_user
 from kept join hits using (src_ip, us)""", "auth",
            counted=_over("count(*)", "src_ip", "auth", 6 * HOUR, "event_kind = 'ssh_failure'"),
            hits="select * from counted where n >= 6", kept=greedy("hits", "src_ip", 6 * HOUR))


def _new_ssh(spark, d):
    t = Tables(spark, d)
    return brief(auth.new_ssh_source(t.auth, CFG, prefixes=t.prefixes), country="string")


_GEO = """select ip, max_by(country, len) country, max_by(country_name, len) country_name from (
 select a.ip, p.country, p.country_name, cast(split_part(cidr, '/', 2) as int) len from (select distinct {col} ip from {src}) a
 join prefixes p on p.country != '' and cast(split_part(a.ip, '.', 4) as int) >> (32 - cast(split_part(cidr, '/', 2) as int))
  = cast(split_part(split_part(cidr, '/', 1), '.', 4) as int) >> (32 - cast(split_part(cidr, '/', 2) as int))
  and a.ip like '203.0.113.%') group by ip"""
_NEW_SSH = duck("""select us, 'medium' severity, 'localhost' affected_host, src_ip related_host,
 concat('new_ssh_login:', src_ip, ':', usr) dedup_key,
 concat('New SSH login: ', usr, ' from ', src_ip, case when country is null then '' else concat(' (', country, ')') end) title,
 0.8::double confidence, coalesce(country, '') country
 from (select * from auth where event_kind = 'ssh_success' qualify row_number() over (partition by src_ip order by us) = 1) f
 left join geo on geo.ip = f.src_ip""", "auth", geo=_GEO.format(col="src_ip", src="auth"))


def _sudo(spark, d):
    t = Tables(spark, d)
    both = auth.sudo_sensitive(t.auth, CFG).unionByName(auth.sudo_failure(t.auth, CFG))
    return brief(both, command="string")


_SUDO = duck("""select us, 'low' severity, 'localhost' affected_host, '' related_host, concat('sudo_sensitive:', command) dedup_key,
 concat('Sensitive sudo command executed: ', command) title, 0.7::double confidence, command from kept
 union all select us, 'low', 'localhost', '', concat('sudo_failure:', strftime(make_timestamp(us), '%Y%m%d%H')),
 'Failed sudo attempt', 0.6::double, null from auth where event_kind = 'sudo_failure'""", "auth",
             hits="select * from auth where event_kind = 'sudo' and (contains(command, '/bin/bash') or contains(command, 'visudo'))",
             kept=greedy("hits", "command", HOUR))


def _accounts(spark, d):
    return brief(auth.new_account(Tables(spark, d).auth, CFG), user="string")


_ACCOUNTS = duck("""select us, 'medium' severity, 'localhost' affected_host, '' related_host, concat('new_user:', usr) dedup_key,
 concat('New user account created: ', usr) title, 1.0::double confidence, usr as "user" from kept""", "auth",
                 hits="select * from auth where event_kind = 'new_user'", kept=greedy("hits", "usr", 24 * HOUR))


def _entropy(spark, d):
    return brief(dns.dns_entropy(Tables(spark, d).dns, CFG), entropy="double", domain="string")


_ENTROPY = duck(f"""select us, 'medium' severity, src_ip affected_host, '' related_host, concat('dga_entropy:', query_name) dedup_key,
 concat('High-entropy domain name: ', query_name) title, 0.65::double confidence, entropy, query_name as "domain"
 from (select query_name, us from kept union
       select query_name, min(us) us from hits group by query_name having min(us) >= {LEARNED}::bigint)
 join hits using (query_name, us)""", "dns",
                ent="""select event_id, round(-sum(p * log2(p)), 3) entropy, -sum(p * log2(p)) raw from (
  select event_id, count(*) / max(length(lab)) p from (select event_id, split_part(query_name, '.', 1) lab,
    unnest(string_split(split_part(query_name, '.', 1), '')) ch from dns) group by event_id, ch) group by event_id""",
                hits="""select dns.*, entropy from dns join ent using (event_id)
 where raw >= 3.0 and length(split_part(query_name, '.', 1)) >= 10""",
                early=f"select * from hits where us < {LEARNED}::bigint", kept=greedy("early", "query_name", HOUR))


def _tunnel(spark, d):
    t = Tables(spark, d)
    return brief(dns.dns_tunnel_label(t.dns, CFG).unionByName(dns.dns_tunnel_txt(t.dns, CFG.but(txt_label=13))),
                 domain="string", label_length="bigint")


_TUNNEL = duck("""select us, 'high' severity, src_ip affected_host, '' related_host, concat('dns_tunnel_label:', head) dedup_key,
 'Possible DNS tunneling: very long subdomain label' title, 0.8::double confidence, query_name as "domain", n label_length
 from kept join long using (head, us)
 union all select us, 'low', src_ip, '', concat('dns_txt_suspicious:', zone), concat('Suspicious DNS TXT query: ', query_name),
 0.55::double, query_name, null from kept_txt join txt using (zone, us)""", "dns",
               labels="""select *, length(split_part(query_name, '.', 1)) n, substr(query_name, 1, 50) head,
   array_to_string(string_split(query_name, '.')[-2:], '.') zone from dns""",
               long="select * from labels where n > 50",
               txt="select * from labels where query_type = 'TXT' and n > 13 and n <= 50",
               kept=greedy("long", "head", HOUR),
               kept_txt=greedy("txt", "zone", HOUR / 2).replace("from kept k", "from kept_txt k"))


def _tld(spark, d):
    return brief(dns.dns_tld(Tables(spark, d).dns, CFG.but(learning_hours=2)), domain="string")


_TLD = duck("""select us, 'info' severity, src_ip affected_host, '' related_host, concat('suspicious_tld:', query_name) dedup_key,
 concat('Query to suspicious TLD: ', query_name) title, 0.4::double confidence, query_name as "domain" from dns
 where query_name like '%.xyz' qualify row_number() over (partition by query_name order by us) = 1
 and us >= 1704074400000000""", "dns")


def _encrypted(spark, d):
    t = Tables(spark, d)
    # Spread the outside web traffic over real resolver addresses as well.
    conn = t.conn.withColumn("dst_ip", F.when((F.col("dst_port") == 443) & (F.col("size") % 2 == 0), "9.9.9.9")
                             .otherwise(F.col("dst_ip")))
    return brief(dns.encrypted_dns(conn, CFG.but(sanctioned_resolvers=("203.0.113.7",))), mode="string", provider="string")


_ENCRYPTED = duck("""select us, 'medium' severity, src_ip affected_host, dst related_host, pair dedup_key,
 concat('Encrypted DNS bypass (', mode, '): ', src_ip, ' → ', provider) title,
 case when mode = 'DoH' then 0.6 else 0.75 end::double confidence, mode, provider from kept join hits using (pair, us)""", "conn",
                  hits="""select *, concat('doh:', src_ip, ':', dst) pair, case when dst_port = 853 then 'DoT' else 'DoH' end mode,
  case when dst = '9.9.9.9' then 'Quad9' else 'an external resolver' end provider from (
  select *, case when dst_port = 443 and size % 2 = 0 then '9.9.9.9' else dst_ip end dst from conn)
  where protocol = 'tcp' and (dst_port = 853 or (dst_port = 443 and dst = '9.9.9.9')) and dst != '203.0.113.7'""",
                  kept=greedy("hits", "pair", 6 * HOUR))


def _conflict(spark, d):
    t = Tables(spark, d)
    both = arp.arp_conflict(t.arp, CFG).unionByName(arp.mac_change(t.arp, CFG))
    return brief(both, known_mac="string", old_mac="string", is_gateway="boolean").drop("title")


_CONFLICT = duck("""select us, case when src_ip = '192.168.1.1' then 'critical' else 'high' end severity, src_ip affected_host,
 '' related_host, concat('arp_conflict:', src_ip, ':', src_mac) dedup_key, 0.9::double confidence, old known_mac, null old_mac,
 src_ip = '192.168.1.1' is_gateway from seen where old != src_mac
 union all select us, case when src_ip = '192.168.1.1' or first_mac = 'b8:27:eb:00:00:10' then 'critical' else 'high' end, src_ip, '',
 concat('mac_change:', src_ip), 0.85::double, null, old, src_ip = '192.168.1.1' or first_mac = 'b8:27:eb:00:00:10'
 from seen where old != src_mac""", "arp",
                 seen="""select *, lag(src_mac) over (partition by src_ip order by us) old,
  first_value(src_mac) over (partition by src_ip order by us) first_mac from arp""")


def _gateway(spark, d):
    return brief(arp.gateway_mac_change(Tables(spark, d).arp, CFG), old_mac="string", new_mac="string")


_GATEWAY = duck("""select us, 'critical' severity, src_ip affected_host, '' related_host, 'gateway_mac_change:192.168.1.1' dedup_key,
 concat('CRITICAL: Gateway MAC changed from ', first_mac, ' to ', src_mac) title, 0.95::double confidence, first_mac old_mac, src_mac new_mac
 from (select *, first_value(src_mac) over (order by us) first_mac from arp where src_ip = '192.168.1.1') where src_mac != first_mac""", "arp")


def _flood(spark, d):
    return brief(arp.arp_flood(Tables(spark, d).arp, CFG), reply_count_10s="bigint")


_FLOOD = duck("""select us, 'high' severity, src_ip affected_host, '' related_host, concat('arp_flood:', src_mac) dedup_key,
 concat('ARP reply flood from ', src_mac) title, 0.85::double confidence, n reply_count_10s from counted where n >= 25""", "arp",
              counted=_over("count(*)", "src_mac", "arp", 24 * HOUR))


def _churn(spark, d):
    return brief(arp.arp_churn(Tables(spark, d).arp, CFG), changes="bigint")


_CHURN = duck("""select us, 'high' severity, 'LAN' affected_host, '' related_host, 'arp_churn:lan' dedup_key,
 'Excessive ARP table churn detected' title, 0.75::double confidence, n changes from (select us, count(*) over (order by us
   range between 86399999999::bigint preceding and current row) n from (
   select us, src_mac != lag(src_mac) over (partition by src_ip order by us) ch from arp) where ch) where n >= 5""", "arp")


def _new_device(spark, d):
    return brief(arp.new_device(Tables(spark, d).arp, CFG))


_NEW_DEVICE = duck("""select us, 'low' severity, src_ip affected_host, '' related_host, concat('new_device:', src_ip, ':', src_mac) dedup_key,
 concat('New device appeared: ', src_ip, case when src_mac like 'b8:%' then ' [Raspberry Pi Foundation]' else '' end) title,
 1.0::double confidence from (select * from arp qualify row_number() over (partition by src_ip order by us) = 1)
 where src_ip != '192.168.1.3' and src_mac != 'b8:27:eb:00:00:15'""", "arp")


def _ip_change(spark, d):
    t = Tables(spark, d)
    shared = F.concat(F.lit("b8:27:eb:00:00:0"), F.split_part("src_ip", F.lit("."), F.lit(4)).cast("int") % 7)
    claims = t.arp.withColumn("src_mac", F.when(F.col("src_mac").startswith("b8"), shared).otherwise(F.col("src_mac")))
    return brief(arp.ip_change(claims, CFG), old_ip="string", new_ip="string")


_IP_CHANGE = duck("""select us, 'medium' severity, ip affected_host, '' related_host, concat('ip_change:', mac) dedup_key,
 concat('Device IP changed: ', mac, ' was ', old_ip, ', now ', ip) title, 0.7::double confidence, old_ip, ip new_ip from (
 select *, last_value(setter ignore nulls) over w last_setter, last_value(ip ignore nulls) over w old_ip from log
  window w as (partition by mac order by us rows between unbounded preceding and 1 preceding))
 where kind = 'same' and last_setter = 'set' and old_ip != ip""", "arp",
                  claims="""select us, src_ip, case when src_mac like 'b8%' then concat('b8:27:eb:00:00:0',
   cast(split_part(src_ip, '.', 4) as int) % 7) else src_mac end src_mac from arp""",
                  seen="select *, lag(src_mac) over (partition by src_ip order by us) old from claims",
                  log="""select us, src_mac mac, src_ip ip, case when old is null or old != src_mac then 'set' end setter,
   case when old = src_mac then 'same' else 'first' end kind from seen
   union all select us, old, null, 'clear', 'gone' from seen where old != src_mac""")


def _beacon(spark, d):
    t = Tables(spark, d)
    known = t.conn.where(F.col("dst_port") == 8003).select("src_ip", "dst_ip", "dst_port", "protocol")
    return brief(beacon.beacon(t.conn, CFG, known), cv="double", interval_count="bigint",
                 mean_interval_seconds="double", min_interval="double", max_interval="double").drop("title")


_BEACON = duck(f"""select us, case when cv < 0.05 then case when known then 'medium' else 'high' end when cv < 0.10 then 'medium' else 'low' end severity,
 src_ip affected_host, dst_ip related_host, concat('beacon:', flow) dedup_key,
 round(case when cv < 0.05 then 0.85 when cv < 0.10 then 0.75 else 0.65 end - case when known then 0.15 else 0 end, 4)::double confidence,
 round(cv, 4) cv, n interval_count, round(mean, 2) mean_interval_seconds, round(lo, 2) min_interval, round(hi, 2) max_interval
 from (select h.*, dst_port = 8003 and us >= {LEARNED}::bigint known from kept join hits h using (flow, us))""", "conn",
               gaps="""select *, (us - lag(us) over (partition by flow order by us)) / 1000000.0 gap from (
   select *, concat(src_ip, ':', dst_ip, ':', dst_port) flow from conn where dst_ip like '203.%' and dst_port not in (53, 123, 443, 80, 5353))""",
               stats="""select *, count(good) over w n, avg(good) over w mean, stddev_pop(good) over w sd, min(good) over w lo, max(good) over w hi
   from (select *, case when gap >= 1 then gap end good from gaps)
   window w as (partition by flow order by us rows between 198 preceding and current row)""",
               hits="select *, sd / mean cv from stats where n >= 5 and mean >= 5 and sd / mean <= 0.5",
               kept=greedy("hits", "flow", 6 * HOUR))


def _beacon_sockets(spark, d):
    return brief(beacon.beacon_from_sockets(Tables(spark, d).sockets, CFG.but(beacon_cv=0.7)), cv="double",
                 interval_count="bigint").drop("title", "confidence", "severity")


_BEACON_SOCKETS = duck("""select us, src_ip affected_host, dst_ip related_host, concat('beacon:', flow) dedup_key, round(cv, 4) cv, n interval_count
 from kept join hits using (flow, us)""", "sockets",
                       gaps="""select *, (us - lag(us) over (partition by flow order by us)) / 1000000.0 gap from (
   select distinct us, local_ip src_ip, remote_ip dst_ip, concat(local_ip, ':', remote_ip, ':', remote_port) flow from sockets
   where state in ('ESTABLISHED', 'SYN_SENT'))""",
                       stats="""select *, count(good) over w n, avg(good) over w mean, stddev_pop(good) over w sd
   from (select *, case when gap >= 1 then gap end good from gaps)
   window w as (partition by flow order by us rows between 198 preceding and current row)""",
                       hits="select *, sd / mean cv from stats where n >= 5 and mean >= 5 and sd / mean <= 0.7",
                       kept=greedy("hits", "flow", 6 * HOUR))


def _half_open(spark, d):
    t = Tables(spark, d)
    cfg = CFG.but(scan_window=120 * HOUR, scan_ports=2, adaptive=Adaptive(enabled=False))
    return brief(scan.port_scan(scan.syn_sent_ports(t.sockets, cfg), cfg), unique_ports_count="bigint")


_HALF_OPEN = duck("""select distinct us, 'low' severity, remote_ip affected_host, local_ip related_host, concat('port_scan:', pair) dedup_key,
 concat('Port scan: ', local_ip, ' → ', remote_ip, ' (', n, ' ports/min)') title, 0.9::double confidence, n unique_ports_count
 from kept join hits using (pair, us)""", "sockets",
                  counted=_over("count(distinct remote_port)", "pair",
                                "(select distinct us, local_ip, remote_ip, remote_port, concat(local_ip, ':', remote_ip) pair "
                                "from sockets where state = 'SYN_SENT')", 120 * HOUR),
                  hits="select * from counted where n >= 2", kept=greedy("hits", "pair", 2 * HOUR))


def _canary(spark, d):
    return brief(scan.canary_hits(Tables(spark, d).conn, CFG), canary_port="bigint")


_CANARY = duck("""select us, 'high' severity, src_ip affected_host, '' related_host, concat('honeypot:', src_ip, ':', dst_port) dedup_key,
 concat('Honeypot triggered: ', src_ip, ' probed canary port ', dst_port) title, 0.95::double confidence, dst_port::bigint canary_port
 from conn where dst_port between 1000 and 1009 and dst_ip like '192.168.1.%'""", "conn")


def _admin_pairs(spark, d):
    t = Tables(spark, d)
    known = t.conn.where("us < 1704240000000000 and dst_port = 22").select("src_ip", "dst_ip", "dst_port", "protocol")
    return brief(scan.new_admin_pair(t.conn, CFG, destinations=known), protocol="string", port="bigint")


_ADMIN_PAIRS = duck(f"""select us, 'medium' severity, dst_ip affected_host, src_ip related_host,
 concat('new_admin:', src_ip, ':', dst_ip, ':', dst_port) dedup_key,
 concat('New ', p, ' connection: ', src_ip, ' → ', dst_ip) title, 0.6::double confidence, p protocol, dst_port::bigint port from (
 select *, case dst_port when 22 then 'SSH' else 'SMB' end p from conn where dst_ip like '192.168.1.%' and dst_port in (22, 445)
 and src_ip != dst_ip qualify row_number() over (partition by src_ip, dst_ip, dst_port order by us) = 1) f
 where us >= {LEARNED}::bigint and not (dst_port = 22 and exists (select 1 from conn c where c.us < 1704240000000000
 and c.src_ip = f.src_ip and c.dst_ip = f.dst_ip and c.dst_port = f.dst_port and c.protocol = 'tcp'))""", "conn")

_INTEL_IP = """case when {ip} in ('203.0.113.5', '203.0.113.9') then {ip}
 when {ip} like '203.0.113.%' and cast(split_part({ip}, '.', 4) as int) between 16 and 31 then '203.0.113.16/28' end"""
_INTEL_NAME = """case when {n} like '%.svc.example.net' then 'svc.example.net' when {n} like '%.bad.xyz' then 'bad.xyz' end"""


def _intel(spark, d):
    t = Tables(spark, d)
    return brief(intel.intel_hits(t.conn, t.dns, t.indicators, CFG), indicator="string", indicator_kind="string",
                 source="string", category="string")


_INTEL = duck("""select h.us, 'high' severity, host affected_host, related related_host, concat('threatintel:', h.ind) dedup_key,
 concat('Known-bad ', kind, ': ', related) title, 0.95::double confidence, h.ind indicator, kind indicator_kind, source, category
 from kept join hits h on h.ind = kept.ind and h.us = kept.us join indicators i on i.value = h.ind
 qualify row_number() over (partition by h.ind, h.us order by step) = 1""", "conn", "dns",
              hits=f"""select us, src_ip host, dst_ip related, ind, 0 step from (select *, {_INTEL_IP.format(ip='dst_ip')} ind from conn
   where dst_ip not like '192.168.%') where ind is not null
   union all select us, src_ip, query_name, ind, 1 from (select *, {_INTEL_NAME.format(n='query_name')} ind from dns) where ind is not null
   union all select us, src_ip, response_ip, ind, 2 from (select *, {_INTEL_IP.format(ip='response_ip')} ind from dns) where ind is not null""",
              kept=greedy("hits", "ind", HOUR))


def _asn(spark, d):
    t = Tables(spark, d)
    return brief(intel.asn_reputation(t.conn, t.prefixes, CFG), asn="bigint", org="string", reason="string")


_ASN = duck("""select us, 'medium' severity, src_ip affected_host, dst_ip related_host, pair dedup_key,
 concat('Connection to flagged network: ', src_ip, ' → ', org, ' (AS', asn, ')') title, 0.55::double confidence, asn::bigint asn, org,
 case asn when 64500 then 'AS64500 is listed as suspicious' when 64501 then 'operator ''Bulletproof Hosting BV'' matches ''bulletproof'''
   else 'operator ''Gamma'' matches ''gamma''' end reason from kept join hits using (pair, us)""", "conn",
            hits="""select *, concat('asn:', src_ip, ':', asn) pair, case asn when 64500 then 'Alpha Net' when 64501 then 'Bulletproof Hosting BV'
   else 'Gamma' end org from (select *, case when o between 4 and 7 then 64501 when o < 16 then 64500 when o < 32 then 64502 end asn from (
   select *, cast(split_part(dst_ip, '.', 4) as int) o from conn where dst_ip like '203.%')) where asn is not null""",
            kept=greedy("hits", "pair", HOUR))


def _destinations(spark, d):
    t = Tables(spark, d)
    return brief(profile.new_destination(t.conn, CFG, prefixes=t.prefixes), remote_port="bigint", protocol="string", country="string")


_DESTINATIONS = duck(f"""select us, 'info' severity, src_ip affected_host, dst_ip related_host, pair dedup_key,
 concat('New destination: ', src_ip, ' → ', dst_ip, ':', dst_port, case when country is null then '' else concat(' (', country, ')') end) title,
 0.6::double confidence, dst_port::bigint remote_port, protocol, coalesce(country, '') country
 from kept join hits using (pair, us) left join geo on geo.ip = dst_ip""", "conn", geo=_GEO.format(col="dst_ip", src="conn"),
                     hits=f"""select * from (select *, concat('new_dest:', src_ip, ':', dst_ip, ':', dst_port) pair from conn
   where dst_ip like '203.%' qualify row_number() over (partition by src_ip, dst_ip, dst_port, protocol order by us) = 1)
   where us >= {LEARNED}::bigint""", kept=greedy("hits", "pair", 24 * HOUR))


def _listeners(spark, d):
    return brief(profile.new_listener(Tables(spark, d).sockets, CFG), port="bigint", process="string", pid="bigint")


_LISTENERS = duck("""select us, case when local_port in (1433, 1521) then 'medium' else 'low' end severity, local_ip affected_host, '' related_host,
 concat('new_listen:', local_port) dedup_key, concat('New listening port: ', local_port, '/tcp (', process_name, ')') title,
 0.85::double confidence, local_port::bigint port, process_name process, pid::bigint pid
 from (select * from sockets where state = 'LISTEN' qualify row_number() over (partition by local_port order by us, event_id) = 1)
 where us > (select min(us) from sockets)""", "sockets")


def _countries(spark, d):
    t = Tables(spark, d)
    return brief(profile.new_country(t.conn, t.prefixes, CFG.but(learning_hours=6)), country="string", country_name="string")


_COUNTRIES = duck("""select us, 'medium' severity, src_ip affected_host, dst_ip related_host, concat('newcountry:', src_ip, ':', country) dedup_key,
 concat('New country for ', src_ip, ': ', case when country_name = '' then country else country_name end) title, 0.5::double confidence, country,
 case when country_name = '' then country else country_name end country_name
 from (select c.*, geo.country, geo.country_name from conn c join geo on geo.ip = c.dst_ip where dst_ip like '203.%'
 qualify row_number() over (partition by src_ip, country order by us) = 1) where us >= 1704088800000000""", "conn",
                  geo=_GEO.format(col="dst_ip", src="conn"))


def _hours(spark, d):
    return brief(profile.active_hours(Tables(spark, d).conn, CFG), hour="bigint", known_hours="bigint")


_HOURS = duck(f"""select us, 'medium' severity, src_ip affected_host, '' related_host, concat('activehour:', src_ip, ':', h) dedup_key,
 concat('Unusual activity hour for ', src_ip, ': ', lpad(cast(h as varchar), 2, '0'), ':00') title, 0.5::double confidence, h as hour, known known_hours
 from (select *, row_number() over (partition by src_ip order by us) - 1 known from (
   select src_ip, hour(make_timestamp(us)) h, min(us) us from conn group by 1, 2)) where known >= 15 and us >= {LEARNED}::bigint""", "conn")


def _off_profile(spark, d):
    return brief(profile.off_profile(Tables(spark, d).conn, CFG), dimension="string", value="string", known="bigint")


_OFF_PROFILE = duck(f"""select us, 'medium' severity, src_ip affected_host, case when dim = 'peer' then v else '' end related_host,
 concat('hostprofile:', dim, ':', src_ip, ':', v) dedup_key, concat(case dim when 'dst_port' then 'Off-profile destination port for '
   when 'peer' then 'Off-profile internal peer for ' when 'protocol' then 'Off-profile protocol for ' else 'Off-profile transfer size for ' end,
   src_ip, ': ', v) title, 0.5::double confidence, dim dimension, v as "value", known
 from (select *, row_number() over (partition by src_ip, dim order by us) - 1 known from (
   select src_ip, dim, v, min(us) us from (
     select us, src_ip, 'dst_port' dim, cast(dst_port as varchar) v from conn
     union all select us, src_ip, 'peer', dst_ip from conn where dst_ip like '192.168.1.%' and dst_ip != src_ip
     union all select us, src_ip, 'protocol', protocol from conn
     union all select us, src_ip, 'byte_range', case when size < 1000 then '0-1K' when size < 10000 then '1K-10K'
       when size < 100000 then '10K-100K' when size < 1000000 then '100K-1M' when size < 10000000 then '1M-10M' else '10M+' end
       from conn where size > 0) group by 1, 2, 3))
 where us >= {LEARNED}::bigint and known >= case dim when 'dst_port' then 40 when 'peer' then 8 when 'protocol' then 1 else 1 end""", "conn")


def _spike(spark, d):
    return brief(volume.connection_spike(Tables(spark, d).conn, CFG.but(spike_min_samples=3)),
                 connection_count="bigint", z_score="double")


_SPIKE = duck(f"""select us, 'medium' severity, src_ip affected_host, '' related_host, concat('conn_spike:', src_ip) dedup_key,
 concat('Connection spike: ', src_ip, ' (', n, ' active)') title, round(least(0.95, 0.5 + z * 0.1), 4) confidence, n connection_count, round(z, 2) z_score
 from kept join hits using (src_ip, us)""", "conn",
              counts="select src_ip, us - us % 21600000000 as us, count(*) n from conn group by 1, 2",
              stats="""select *, case when sd < 1e-9 then abs(n - mean) else (n - mean) / sd end z from (
   select *, count(*) over w c, avg(n) over w mean, stddev_pop(n) over w sd from counts
   window w as (partition by src_ip, hour(make_timestamp(us)), isodow(make_timestamp(us)) order by us))""",
              hits=f"select * from stats where c >= 3 and (n > mean * 2.0 or z > 2.0) and us >= {LEARNED}::bigint",
              kept=greedy("hits", "src_ip", 12 * HOUR))


def _traffic(spark, d):
    t = Tables(spark, d)
    return brief(volume.traffic_spike(volume.iface_rate(t.counters), CFG.but(traffic_factor=3.0, spike_z=3.0)),
                 bytes_per_minute="double", z_score="double").drop("confidence")


_TRAFFIC = duck(f"""select us, 'medium' severity, name affected_host, '' related_host, concat('traffic_spike:', name) dedup_key,
 concat('Traffic spike on ', name) title, round(bpm, 2) bytes_per_minute, round(z, 2) z_score from (
 select *, case when sd < 1e-9 then abs(bpm - mean) else (bpm - mean) / sd end z from (
  select *, count(*) over w c, avg(bpm) over w mean, coalesce(stddev_pop(bpm) over w, 0) sd from rate
  window w as (partition by name order by us rows between unbounded preceding and 1 preceding)))
 where c >= 5 and (bpm > mean * 3.0 or z > 3.0) and us >= {LEARNED}::bigint""", "counters",
                rate="""select name, us, case when t >= lag(t) over w then t - lag(t) over w else t end / ((us - lag(us) over w) / 60000000.0) bpm
   from (select *, rx_bytes + tx_bytes t from counters) window w as (partition by name order by us)
   qualify lag(t) over w is not null""")

ENTRIES = {
    "port_scan": (_port_scan, _PORT_SCAN), "host_sweep": (_host_sweep, _HOST_SWEEP),
    "half_open_scan": (_half_open, _HALF_OPEN), "lateral_fanout": (_lateral, _LATERAL),
    "nxdomain_rate": (_nxdomain, _NXDOMAIN), "dga_rate": (_dga, _DGA), "ssh_brute_force": (_ssh, _SSH),
    "arp_flood": (_flood, _FLOOD), "arp_churn": (_churn, _CHURN), "beacon": (_beacon, _BEACON),
    "beacon_sockets": (_beacon_sockets, _BEACON_SOCKETS), "dns_entropy": (_entropy, _ENTROPY),
    "dns_tunnel": (_tunnel, _TUNNEL), "dns_suspicious_tld": (_tld, _TLD),
    "encrypted_dns": (_encrypted, _ENCRYPTED), "arp_conflict_mac_change": (_conflict, _CONFLICT),
    "gateway_mac_change": (_gateway, _GATEWAY), "intel_hits": (_intel, _INTEL), "asn_reputation": (_asn, _ASN),
    "canary_hits": (_canary, _CANARY), "sudo": (_sudo, _SUDO), "new_account": (_accounts, _ACCOUNTS),
    "new_destination": (_destinations, _DESTINATIONS), "new_listener": (_listeners, _LISTENERS),
    "new_admin_pair": (_admin_pairs, _ADMIN_PAIRS), "new_ssh_source": (_new_ssh, _NEW_SSH),
    "new_country": (_countries, _COUNTRIES), "active_hours": (_hours, _HOURS), "off_profile": (_off_profile, _OFF_PROFILE),
    "connection_spike": (_spike, _SPIKE), "traffic_spike": (_traffic, _TRAFFIC), "new_device": (_new_device, _NEW_DEVICE),
    "ip_change": (_ip_change, _IP_CHANGE),
}
