"""Event projections of the given tables, for Spark and for the checking SQL, from one text.

Only `base` differs between the engines.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanwatch.functions.names import once

HOUR = 3600
US_HOUR = 3_600_000_000

_BASE_DUCK = """select event_id, epoch_us(ts) us, user_id, event_type, value,
 cast(json_extract_string(props, '$.k') as int) k from events"""
_BASE_SPARK = """select event_id, unix_micros(cast(ts as timestamp)) us, user_id, event_type, value,
 cast(get_json_object(props, '$.k') as int) k from {events}"""

_IP = "concat('192.168.1.', cast({} as varchar(10)))"
_PUB = "concat('203.0.113.', cast({} as varchar(10)))"

PROJECTIONS = {
    "conn": f"""select event_id, us, {_IP.format('user_id % 20 + 10')} src_ip,
 case when event_type in ('click','error') then {_IP.format('k % 25 + 10')}
      else {_PUB.format('k % 40 + 1')} end dst_ip,
 case event_type when 'click' then case when k % 2 = 0 then 22 else 445 end when 'error' then 1000 + k
      when 'view' then 443 when 'purchase' then 8000 + k % 10 else 853 end dst_port,
 case when event_type = 'signup' and k % 5 = 0 then 'udp' else 'tcp' end protocol,
 case when k % 4 = 3 then 'A' else 'S' end flags, cast(floor(value * 10000) as bigint) size,
 concat('sensor-', cast(user_id % 3 as varchar(10))) sensor from base""",
    "dns": f"""select event_id, us, {_IP.format('user_id % 20 + 10')} src_ip,
 concat(case when k % 20 = 0 then concat(md5(cast(event_id as varchar(20))), md5(cast(k as varchar(20))))
             when k % 3 = 0 then substr(md5(cast(k as varchar(20))),1,14)
             else concat('host', cast(k as varchar(10))) end,
        case k % 4 when 0 then '.example.com' when 1 then '.svc.example.net' when 2 then '.bad.xyz'
                   else '.cdn.example.org' end) query_name,
 case when event_type = 'signup' then 'TXT' else 'A' end query_type, event_type = 'error' is_nxdomain,
 {_PUB.format('k % 40 + 1')} response_ip from base""",
    "arp": f"""select event_id, us, 2 op, {_IP.format('user_id % 20 + 1')} src_ip,
 case when k = 7 then 'de:ad:be:ef:00:01'
      else concat('b8:27:eb:00:00:', lpad(cast(user_id % 20 + 10 as varchar(10)),2,'0')) end src_mac
 from base""",
    "auth": f"""select event_id, us, {_PUB.format('user_id % 12 + 1')} src_ip,
 concat('user', cast(k % 7 as varchar(10))) usr,
 case event_type when 'error' then 'ssh_failure' when 'signup' then 'ssh_failure' when 'view' then 'ssh_success'
      when 'click' then case when k % 10 = 0 then 'sudo_failure' else 'sudo' end else 'new_user' end event_kind,
 case k % 3 when 0 then concat('/bin/bash -c job', cast(k as varchar(10))) when 1 then '/usr/bin/id'
            else concat('/usr/sbin/visudo ', cast(k % 5 as varchar(10))) end command from base""",
    "sockets": f"""select event_id, us - us % {US_HOUR} as us, {_IP.format('user_id % 20 + 10')} local_ip,
 case when event_type = 'click' then 1000 + cast(event_id % 900 as int) else 40000 + k end local_port,
 {_PUB.format('k % 40 + 1')} remote_ip, 4000 + k % 7 remote_port,
 case event_type when 'click' then 'LISTEN' when 'error' then 'SYN_SENT' when 'signup' then 'TIME_WAIT'
      else 'ESTABLISHED' end state, 'tcp' protocol, concat('proc', cast(k % 6 as varchar(10))) process_name,
 k pid from base""",
    "counters": """select event_id, us, concat('eth', cast(user_id % 3 as varchar(10))) name,
 cast(event_id % 700 * 100000 + k as bigint) rx_bytes, cast(event_id % 900 * 20000 as bigint) tx_bytes
 from base""",
    # Alerts of a month squeezed into half a day, so that cooldowns and windows matter.
    "raised": f"""select concat('a', cast(event_id as varchar(20))) alert_id,
 1704067200000000 + cast(floor((us - 1704067200000000) / 60) as bigint) as us,
 case k % 5 when 0 then 'info' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end severity,
 case event_type when 'click' then 'lateral_movement' when 'error' then 'port_scan' when 'view' then 'dns_anomaly'
      when 'purchase' then 'threat_intel' else case when k % 2 = 0 then 'new_device' else 'auth_anomaly' end end category,
 {_IP.format('user_id % 20 + 10')} affected_host,
 concat('b8:27:eb:00:00:', lpad(cast(user_id % 20 + 10 as varchar(10)),2,'0')) affected_mac,
 case when event_type = 'purchase' and k % 3 = 0 then 'evil.bad.xyz' when event_type in ('view','purchase')
      then {_PUB.format('k % 70 + 1')} when k % 9 = 0 then '' else {_IP.format('k % 25 + 10')} end related_host,
 concat('seen ', event_type) title, concat('k=', cast(k as varchar(10)), ' a|b') description,
 'check it' recommended_action, cast(0.5 + k % 5 / 10.0 as double) confidence, 'rule' confidence_rationale,
 concat(event_type, ':', cast(user_id % 20 as varchar(10)), ':', cast(k % 2 as varchar(10))) dedup_key,
 'new' status, case when event_type = 'signup' then concat('{{"src_ip":"203.0.113.', cast(k % 5 as varchar(10)), '"}}')
                    else '{{}}' end extra,
 case when user_id % 4 = 3 then null else concat('sensor-', cast(user_id % 4 as varchar(10))) end sensor from base""",
}

# Dimension rows, joined to the events.
PREFIXES = """select * from (values
 ('203.0.113.0/28','US','United States',64500,'Alpha Net'), ('203.0.113.4/30','NL','Netherlands',64501,'Bulletproof Hosting BV'),
 ('203.0.113.16/28','DE','',64502,'Gamma'), ('203.0.113.32/28','','',64503,''), ('203.0.113.48/28','FR','France',null,''))
 t(cidr, country, country_name, asn, org)"""
INDICATORS = """select * from (values
 ('203.0.113.5','ip','feodo','botnet_c2',1), ('203.0.113.9','ip','feodo','botnet_c2',2),
 ('203.0.113.16/28','cidr','spamhaus_drop','hijacked_netblock',3), ('203.0.113.16/30','cidr','spamhaus_drop','other',4),
 ('bad.xyz','domain','urlhaus','malware_distribution',5), ('example.net','domain','urlhaus','malware_distribution',6),
 ('svc.example.net','domain','urlhaus','special',7))
 t(value, kind, source, category, feed_order)"""


class Tables:
    """The projections as DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        return self.spark.sql(_BASE_SPARK, events=self.table("events"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            text = PROJECTIONS[name].replace("{", "{{").replace("}", "}}")
            self.__dict__[name] = self.spark.sql(text.replace("from base", "from {base}"), base=self.base)
            return self.__dict__[name]
        raise AttributeError(name)

    @property
    def prefixes(self) -> DataFrame:
        return self.spark.sql(PREFIXES)

    @property
    def indicators(self) -> DataFrame:
        return self.spark.sql(INDICATORS)


def duck(query: str, *needs: str, **ctes: str) -> str:
    """Checking SQL: the needed projections, extra CTEs, then the query."""
    parts = [f"base as ({_BASE_DUCK})"]
    for n in needs:
        parts.append(f"{n} as ({PROJECTIONS[n]})")
    named = {"prefixes": PREFIXES, "indicators": INDICATORS}
    for n, text in named.items():
        if n in query or any(n in t for t in ctes.values()):
            parts.append(f"{n} as ({text})")
    parts += [f"{n} as ({t})" for n, t in ctes.items()]
    return "with recursive " + ",\n".join(parts) + "\n" + query


def greedy(source: str, key: str, seconds: float) -> str:
    """Kept (key, us) of a cooldown, one recursion step per kept row."""
    us = int(seconds * 1_000_000)
    return f"""select {key}, min(us) us from {source} group by {key}
 union all select c.{key}, min(c.us) from kept k join {source} c
 on c.{key} = k.{key} and c.us >= k.us + {us}::bigint group by c.{key}"""


def adaptive_fold(source: str, host: str, pair: str, count: str, base: int, cooldown: int, window: int,
                  trips: int, step: float = 0.5, top: float = 4.0) -> dict[str, str]:
    """CTEs `ranked` and `fold`: candidates one by one with the list of earlier alerts."""
    win, cd = window * 1_000_000, cooldown * 1_000_000
    recent = f"len(list_filter(f.fires, lambda x: x.us >= c.us - {win}::bigint))"
    limit = (f"{base} * case when {recent} < {trips} then 1.0 else "
             f"least({top}, 1.0 + {step} * ({recent} - {trips} + 1)) end")
    quiet = f"len(list_filter(f.fires, lambda x: x.p = c.{pair} and c.us - x.us < {cd}::bigint)) > 0"
    fire = f"(not ({quiet}) and c.{count} >= {limit})"
    return {
        "ranked": f"select *, row_number() over (partition by {host} order by us) rn from {source}",
        "fold": f"""select {host}, rn, us, cast({base} as double) threshold, true fired,
   [{{'p': {pair}, 'us': us}}] fires from ranked where rn = 1
 union all select c.{host}, c.rn, c.us, cast({limit} as double), {fire},
   case when {fire} then list_append(f.fires, {{'p': c.{pair}, 'us': c.us}}) else f.fires end
 from fold f join ranked c on c.{host} = f.{host} and c.rn = f.rn + 1""",
    }


def brief(alerts: DataFrame, also: dict | None = None, **metrics: str) -> DataFrame:
    """Comparable columns of alerts: `metrics` maps an `extra` field to its type, `also` a name to
    a JSON path and type."""
    alerts = once(alerts, _extra=F.col("extra")).drop("extra").withColumnRenamed("_extra", "extra")
    return alerts.select(
        *[F.get_json_object("extra", path).cast(t).alias(n) for n, (path, t) in (also or {}).items()],
        "us", "severity", "affected_host", "related_host", "dedup_key", "title",
        F.round("confidence", 4).alias("confidence"),
        *[F.get_json_object("extra", f"$.{m}").cast(t).alias(m) for m, t in metrics.items()])
