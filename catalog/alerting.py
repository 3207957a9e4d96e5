"""Alert stream, incidents, scores, responses and exports."""

from pyspark.sql import functions as F

from lanwatch.config import Config, ResponseConfig
from lanwatch.functions.names import once
from lanwatch.operators.lineage import work_folder
from lanwatch.plans import alerts as plans, incidents as inc, responses, scores
from lanwatch.sources import sinks
from lanwatch.streaming import late

from .base import Tables, brief, duck
from .detections import START

CFG = Config(quiet_enabled=True, quiet_start=23, quiet_end=2, correlation_window=900, correlation_targets=7,
             correlation_cooldown=1800, gateway_ip="192.168.1.12", gateway_mac="b8:27:eb:00:00:12")
_ID = "cast(substr(alert_id, 2) as int)"


def _id(c="alert_id"):
    return F.substring(c, 2, 20).cast("int")


# Cooldown seconds of the categories that occur, critical ones at most 120.
_CD = """case when severity = 'critical' then 120 when category in ('new_device', 'threat_intel') then 3600
 when category = 'dns_anomaly' then 600 else 300 end"""


def _chain(source, name="kept"):
    return f"""select dedup_key, min(us) us, true fired from {source} group by 1
 union all select c.dedup_key, min(c.us), arg_min(c.us - c.cd, c.us) > max(k.us) from {name} k join {source} c
 on c.dedup_key = k.dedup_key and c.us - c.cd >= k.us group by 1"""


def _dedup(spark, d):
    return plans.dedup(Tables(spark, d).raised).select("alert_id", "us", "dedup_key", "severity")


_DEDUP = duck("select alert_id, us, dedup_key, severity from kept join timed using (dedup_key, us) where fired", "raised",
              timed=f"select *, {_CD} * 1000000::bigint cd from raised", kept=_chain("timed"))


def _dedup_history(spark, d):
    t = Tables(spark, d)
    cut = START + 6 * 3600 * 1_000_000
    first = plans.dedup(t.raised.where(F.col("us") < cut))
    return plans.dedup(t.raised.where(F.col("us") >= cut), first.select("dedup_key", "us")).select(
        "alert_id", "us", "dedup_key")


_DEDUP_HISTORY = duck(f"""select alert_id, us, dedup_key from kept join timed using (dedup_key, us)
 where fired and us >= {START + 6 * 3600 * 1_000_000}""", "raised",
                      timed=f"select *, {_CD} * 1000000::bigint cd from raised", kept=_chain("timed"))


def _mutes(spark, d):
    t = Tables(spark, d)
    muted = t.raised.where(_id() % 997 == 5).select("dedup_key", "us")
    return plans.apply_mutes(plans.quiet_hours(t.raised, CFG), muted).select("alert_id", "us", "dedup_key")


_MUTES = duck(f"""select alert_id, us, dedup_key from raised a where (severity in ('high', 'critical')
  or not (hour(make_timestamp(us)) >= 23 or hour(make_timestamp(us)) < 2))
 and not exists (select 1 from raised m where {_ID.replace('alert_id', 'm.alert_id')} % 997 = 5 and m.dedup_key = a.dedup_key and a.us >= m.us
  and a.us < m.us + (604800 + {_CD.replace('severity', 'a.severity').replace('category', 'a.category')}) * 1000000::bigint)""", "raised")


def _status(spark, d):
    t = Tables(spark, d)
    log = t.raised.where(_id() % 3 == 0).select("alert_id", "us", F.lit("acknowledged").alias("status")).unionByName(
        t.raised.where(_id() % 6 == 0).select("alert_id", (F.col("us") + 1).alias("us"), F.lit("resolved").alias("status")))
    return plans.with_status(t.raised, log).select("alert_id", "status")


_STATUS = duck(f"""select alert_id, case when {_ID} % 6 = 0 then 'resolved' when {_ID} % 3 = 0 then 'acknowledged' else 'new' end status
 from raised""", "raised")


def _enrich(spark, d):
    t = Tables(spark, d)
    swapped = t.raised.withColumn("affected_host", F.when(_id() % 4 == 0, "203.0.113.6").otherwise(F.col("affected_host")))
    out = plans.enrich(swapped, t.prefixes)
    part = {n: F.get_json_object("extra", f"$.enrichment.{n}") for n in ("ip", "country", "country_name", "asn", "asn_org")}
    return once(out, _x=F.col("extra")).drop("extra").withColumnRenamed("_x", "extra").select("alert_id", "description", *[c.alias(n) for n, c in part.items()],
                      F.get_json_object("extra", "$.src_ip").alias("src_ip"))


_ENRICH = duck(f"""select alert_id, concat(description, case when b.ip0 is null then '' else concat(' [', concat_ws(', ', b.country_name,
   case when b.asn is not null then concat('AS', b.asn, case when b.asn_org = '' then '' else concat(' ', b.asn_org) end) end), ']') end) description,
 b.ip0 ip, b.country, b.country_name, b.asn::varchar asn, b.asn_org, json_extract_string(extra, '$.src_ip') src_ip
 from (select * replace (case when {_ID} % 4 = 0 then '203.0.113.6' else affected_host end as affected_host) from raised) a
 left join facts r on r.ip0 = a.related_host left join facts f on f.ip0 = a.affected_host and r.ip0 is null
 left join facts b on b.ip0 = coalesce(r.ip0, f.ip0)""", "raised",
               facts="""select ip0, case when o < 16 and not (o between 4 and 7) then 'US' when o between 4 and 7 then 'NL' when o < 32 then 'DE' when o >= 48 then 'FR' end country,
   case when o < 16 and not (o between 4 and 7) then 'United States' when o between 4 and 7 then 'Netherlands' when o < 32 then 'DE' when o >= 48 then 'France' end country_name,
   case when o between 4 and 7 then 64501 when o < 16 then 64500 when o < 32 then 64502 when o < 48 then 64503 end asn,
   case when o between 4 and 7 then 'Bulletproof Hosting BV' when o < 16 then 'Alpha Net' when o < 32 then 'Gamma' when o < 48 then '' end asn_org
   from (select concat('203.0.113.', o) ip0, o from range(0, 64) x(o))""")


def _stats(spark, d):
    t = Tables(spark, d)
    out = plans.suppression_stats(t.raised, plans.dedup(plans.quiet_hours(t.raised, CFG)))
    return out.withColumn("suppression_rate", F.round("suppression_rate", 6))


_STATS = duck("""select p total_processed, p - f total_suppressed, f total_fired, round((p - f) / p, 6) suppression_rate from (
 select (select count(*) from raised) p, (select count(*) from kept where fired) f)""", "raised",
              timed=f"""select *, {_CD} * 1000000::bigint cd from raised where severity in ('high', 'critical')
  or not (hour(make_timestamp(us)) >= 23 or hour(make_timestamp(us)) < 2)""", kept=_chain("timed"))


def _incidents(spark, d):
    out = brief(inc.incidents(Tables(spark, d).raised, CFG), event_count="bigint", target_count="bigint", peak_severity="string",
                categories="string")
    return out


_ACTORS = """select *, case when tgt != actor then tgt end target from (select *, coalesce(sensor, 'local') sen,
  case when category in ('port_scan', 'lateral_movement') then coalesce(nullif(related_host, ''), affected_host)
   when category = 'auth_anomaly' then coalesce(nullif(json_extract_string(extra, '$.src_ip'), ''), nullif(related_host, ''), affected_host)
   else coalesce(nullif(affected_host, ''), related_host) end actor,
  nullif(case when category in ('port_scan', 'lateral_movement') then affected_host else related_host end, '') tgt from raised)"""
_INCIDENT_PARTS = dict(acted=_ACTORS,
                       counted="""select *, count(distinct sen) over w s, count(distinct target) over w t, count(*) over w n,
   max(list_position(['info','low','medium','high','critical'], severity)) over w peak from acted
   window w as (partition by actor order by us range between 900000000 preceding and current row)""",
                       starts="""select l.actor, l.us done, max(n.us) began from acted l join acted s on s.actor = l.actor and s.us < l.us and s.us >= l.us - 900000000
   join acted n on n.actor = l.actor and n.us < s.us and n.us >= l.us - 900000000 where l.category = 'lateral_movement' and s.category = 'port_scan'
   and n.category = 'new_device' group by 1, 2""",
                       hits="""select * from (select c.*, s >= 2 or t >= 7 broad, exists (select 1 from starts z where z.actor = c.actor and z.done <= c.us
   and z.began >= c.us - 900000000) staged from counted c) where broad or staged""",
                       kept="""select actor, min(us) us from hits group by 1 union all select c.actor, min(c.us) from kept k join hits c
   on c.actor = k.actor and c.us >= k.us + 1800000000 group by 1""")
_INCIDENTS = duck("""select us, case when broad and (s >= 3 or t >= 20) then 'critical' else 'high' end severity, actor affected_host, '' related_host,
 case when broad then concat('incident:', actor) else concat('incident:sequence:', actor) end dedup_key,
 case when broad then concat('Correlated incident: ', actor, ' active across ', s, ' sensor(s), ', t, ' target(s)')
  else concat('Possible intrusion sequence: ', actor) end title, case when broad then 0.8 else 0.85 end::double confidence,
 case when broad then n else 3 end event_count, case when broad then t end target_count,
 case when broad then ['info','low','medium','high','critical'][peak] end peak_severity,
 case when broad then (select concat('["', string_agg(distinct category, '","' order by category), '"]') from acted e where e.actor = x.actor
   and e.us between x.us - 900000000 and x.us) end categories
 from (select h.* from kept join hits h using (actor, us)) x""", "raised", **_INCIDENT_PARTS)


def _evidence(spark, d):
    raised = Tables(spark, d).raised
    rows = inc.incident_evidence(raised, CFG).select("actor", "incident_us", "alert_id", "alert_us", "category", "sensor", "target", "stage")
    short = inc.incidents(raised, CFG, timeline=False).select(
        F.col("affected_host").alias("actor"), F.col("us").alias("incident_us"),
        F.get_json_object("extra", "$.event_count").cast("bigint").alias("event_count"), "description")
    return rows.join(short, ["actor", "incident_us"])


_EVIDENCE = duck("""select x.actor, x.us incident_us, e.alert_id, e.us alert_us, e.category, e.sen sensor, e.target,
 case when broad then n else 3 end event_count,
 case when broad then concat(x.actor, ' caused ', n, ' alerts in 900 s, up to ', ['info','low','medium','high','critical'][peak], '.')
  else concat(x.actor, ' appeared, scanned and moved on, in this order.') end description,
 case when broad then null when (e.us, e.alert_id) = (t0.us, t0.alert_id) then 1 when (e.us, e.alert_id) = (t1.us, t1.alert_id) then 2
  when (e.us, e.alert_id) = (t2.us, t2.alert_id) then 3 end stage
 from (select h.* from kept join hits h using (actor, us)) x join acted e on e.actor = x.actor and e.us between x.us - 900000000 and x.us
 left join lateral (select us, alert_id from acted z where z.actor = x.actor and z.us between x.us - 900000000 and x.us and z.category = 'new_device'
  order by us, alert_id limit 1) t0 on true
 left join lateral (select us, alert_id from acted z where z.actor = x.actor and z.us <= x.us and (z.us, z.alert_id) > (t0.us, t0.alert_id)
  and z.category = 'port_scan' order by us, alert_id limit 1) t1 on true
 left join lateral (select us, alert_id from acted z where z.actor = x.actor and z.us <= x.us and (z.us, z.alert_id) > (t1.us, t1.alert_id)
  and z.category = 'lateral_movement' order by us, alert_id limit 1) t2 on true""", "raised", **_INCIDENT_PARTS)


def _alert_flow(spark, d):
    t = Tables(spark, d)
    return plans.process(t.raised, CFG, t.prefixes).select("alert_id", "us", "category", "dedup_key", "severity")


# Quiet hours and dedup of the raw alerts, incidents of what fired, and dedup of their alerts.
_ALERT_FLOW = duck("""select alert_id, us, category, dedup_key, severity from passed
 union all select sha256(concat_ws('|', dedup_key, us)), us, 'incident', dedup_key, severity from told join found using (dedup_key, us) where fired""", "raised",
                   timed=f"""select *, {_CD} * 1000000::bigint cd from raised where severity in ('high', 'critical')
  or not (hour(make_timestamp(us)) >= 23 or hour(make_timestamp(us)) < 2)""", first=_chain("timed", "first"),
                   passed="select t.* from first join timed t using (dedup_key, us) where fired",
                   **{**_INCIDENT_PARTS, "acted": _ACTORS.replace("from raised", "from passed")},
                   found="""select us, dedup_key, severity, case severity when 'critical' then 120 else 600 end * 1000000::bigint cd from (
   select us, case when broad and (s >= 3 or t >= 20) then 'critical' else 'high' end severity,
   case when broad then concat('incident:', actor) else concat('incident:sequence:', actor) end dedup_key from kept join hits using (actor, us))""",
                   told=_chain("found", "told"))


def _late_flow(spark, d):
    """The same rows from two micro-batches that come in the wrong order."""
    raised, path, cut = Tables(spark, d).raised, work_folder(spark), START + 6 * 3600 * 1_000_000
    step = late.late_alert_batches(lambda batch: batch, path, CFG)
    step(raised.where(F.col("us") >= cut), 0)
    step(raised.where(F.col("us") < cut), 1)
    return late.alerts_in_force(spark, path).select("alert_id", "us", "category", "dedup_key", "severity")


def _search(spark, d):
    t = Tables(spark, d)
    a = plans.search(t.raised, since_us=START + 3_600_000_000, severity="high", sensor="local", limit=None)
    b = plans.search(t.raised, host="192.168.1.14", sensor="sensor-0", limit=25)
    c = plans.by_id(t.raised, "a77")
    return a.unionByName(b).unionByName(c).select("alert_id", "us", "affected_host")


_SEARCH = duck(f"""select alert_id, us, affected_host from raised where us >= {START + 3_600_000_000} and severity = 'high' and sensor is null
 union all (select alert_id, us, affected_host from raised where affected_host = '192.168.1.14' and sensor = 'sensor-0' order by us desc limit 25)
 union all select alert_id, us, affected_host from raised where alert_id = 'a77'""", "raised")


def _devices(t):
    return t.arp.groupBy(F.concat(F.lit("192.168.1."), F.split_part("src_ip", F.lit("."), F.lit(4)).cast("int") + 9).alias("ip")).agg(
        F.lit(START).cast("bigint").alias("first_seen"), F.max("us").alias("last_seen"), F.max("src_mac").alias("mac")).where("ip != '192.168.1.13'")


_POINTS = """select ip, us, from_alert, least(10, sum(delta) over w / 1000000)::double score, count(*) over w alert_count from (
  select affected_host ip, us, true from_alert, 1 o, alert_id, case severity when 'info' then 50000 when 'low' then 100000 when 'medium' then 200000
    when 'high' then 400000 else 800000 end delta from raised
  union all select affected_host, us, false, 0, alert_id, 500000 from raised where category = 'port_scan' and severity = 'high')
 where ip != '192.168.1.13' window w as (partition by ip order by us, o, alert_id rows unbounded preceding)"""


def _points(t):
    bumped = t.raised.where("category = 'port_scan' and severity = 'high'").withColumn("dedup_key", F.lit("arp_conflict:x"))
    return scores.suspicion(t.raised, scores.bumps(bumped), _devices(t))


def _suspicion(spark, d):
    out = _points(Tables(spark, d))
    return out.select("ip", "us", "from_alert", F.round("score", 6).alias("score"), "alert_count")


_SUSPICION = duck("select ip, us, from_alert, round(score, 6) score, alert_count from points", "raised", points=_POINTS)


def _trend(spark, d):
    pts = scores.history(_points(Tables(spark, d)))
    return scores.suspicion_trend(pts, START + 3_600_000_000, 40).select("ip", "us", F.round("score", 6).alias("score"))


_TREND = duck(f"""select ip, us, round(score, 6) score from points where from_alert and us >= {START + 3_600_000_000}
 qualify row_number() over (partition by ip order by us desc) <= 40""", "raised", points=_POINTS)

RC = ResponseConfig(enabled=True, dry_run=False, trusted_categories=("dns_anomaly",),
                    block_categories=("threat_intel", "dns_anomaly"), sinkhole_backend="pihole",
                    custom_command=("notify", "{ip}", "{mac}", "{related}", "{category}/{severity}"), custom_categories=("lateral_movement",))


def _responses(spark, d):
    t = Tables(spark, d)
    cfg = CFG.but(allow_ips=("203.0.113.9",))
    spoof = t.raised.where("category = 'new_device'").withColumn("category", F.lit("arp_anomaly")).withColumn(
        "extra", F.when(F.col("affected_host") == "192.168.1.12", '{"is_gateway":true}').otherwise('{"is_gateway":false}'))
    out = responses.response_plan(t.raised.where("category != 'new_device'").unionByName(spoof), RC, cfg)
    return out.select("alert_id", "responder", "target", "status", F.array_join("commands", ";").alias("commands"))


_RESPONSES = duck("""select alert_id, 'firewall' responder, related_host target, case when category = 'dns_anomaly' then 'ready' else 'pending' end status,
 concat('iptables -I OUTPUT -d ', related_host, ' -j DROP;iptables -I INPUT -s ', related_host, ' -j DROP') commands from raised
 where category in ('threat_intel', 'dns_anomaly') and severity in ('high', 'critical') and related_host like '203.%' and related_host != '203.0.113.9'
 union all select alert_id, 'dns_sinkhole', related_host, case when category = 'dns_anomaly' then 'ready' else 'pending' end, concat('pihole -b ', related_host)
 from raised where category in ('threat_intel', 'dns_anomaly') and severity in ('high', 'critical') and related_host = 'evil.bad.xyz'
 union all select alert_id, 'arp_restore', '192.168.1.12', 'pending', 'arp -s 192.168.1.12 b8:27:eb:00:00:12' from raised
 where category = 'new_device' and affected_host = '192.168.1.12' and severity in ('high', 'critical')
 union all select alert_id, 'killswitch', affected_host, 'pending', concat('notify ', affected_host, ' ', affected_mac, ' ', related_host, ' lateral_movement/critical')
 from raised where category = 'lateral_movement' and severity = 'critical'""", "raised")

_RT = "concat(strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S'), case when us % 1000000 = 0 then '' else concat('.', lpad(cast(us % 1000000 as varchar), 6, '0')) end, '+00:00')"
_SWAP = "category in ('port_scan', 'lateral_movement') and related_host != ''"


def _cef(spark, d):
    return sinks.to_syslog_lines(Tables(spark, d).raised, "local3", "sensor", "cef")


_CEF = duck(f"""select alert_id, concat('<', 152 + case severity when 'info' then 6 when 'low' then 5 when 'medium' then 4 when 'high' then 3 else 2 end,
 '>1 ', rt, ' sensor lanwatch - - - CEF:0|lanwatch|lanwatch|1.0.0|', category, '|', title, '|', case severity when 'info' then 1 when 'low' then 3
 when 'medium' then 5 when 'high' then 8 else 10 end, '|externalId=', alert_id, ' rt=', rt, ' cat=', category, ' src=', src,
 case when sw then '' else concat(' smac=', affected_mac) end, case when dst = '' then '' else concat(' dst=', dst) end,
 ' msg=', replace(description, '=', '\\='), ' cn1=', cast(confidence as double), ' cn1Label=confidence cs1=check it cs1Label=recommendedAction') as "value"
 from (select *, {_RT} rt, {_SWAP} sw, case when {_SWAP} then related_host else affected_host end src,
  case when {_SWAP} then affected_host else related_host end dst from raised)""", "raised")


def _fields(df, schema, **paths):
    """Fields of JSON documents, each parsed once."""
    doc = once(df, doc=F.from_json("value", schema))
    return doc.select("alert_id", *[F.expr(f"doc.{p}").alias(n) for n, p in paths.items()])


_ECS_DOC = ("`@timestamp` string, event struct<category: string, severity: string, action: string>, source struct<ip: string, mac: string>, "
            "host struct<ip: string>, destination struct<ip: string>, lanwatch struct<confidence: string, extra: string>, log struct<level: string>")


def _ecs(spark, d):
    return _fields(sinks.to_ecs(Tables(spark, d).raised), _ECS_DOC, ts="`@timestamp`", kind="event.category", sev="event.severity",
                   action="event.action", src="source.ip", mac="source.mac", host="host.ip", dst="destination.ip",
                   conf="lanwatch.confidence", extra="lanwatch.extra", level="log.level")


_ECS = duck(f"""select alert_id, {_RT} ts, case when category in ('port_scan', 'lateral_movement') then '["network","intrusion_detection"]'
  when category = 'new_device' then '["host"]' when category = 'auth_anomaly' then '["authentication"]'
  when category = 'threat_intel' then '["threat","intrusion_detection"]' else '["network"]' end kind,
 cast(list_position(['info','low','medium','high','critical'], severity) * 2 - 1 as varchar) sev, category action,
 case when {_SWAP} then related_host else affected_host end src, case when {_SWAP} then null else affected_mac end mac, affected_host host,
 nullif(case when {_SWAP} then affected_host else related_host end, '') dst, cast(cast(confidence as double) as varchar) conf,
 case when extra = '{{}}' then null else extra end extra, severity "level" from raised""", "raised")


_OTLP_DOC = ("resourceLogs array<struct<resource: struct<attributes: array<struct<value: struct<stringValue: string>>>>, "
             "scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, severityNumber: string, severityText: string, "
             "body: struct<stringValue: string>, attributes: array<struct<value: struct<stringValue: string>>>>>>>>>")


def _otlp(spark, d):
    log, attribute = "resourceLogs[0].scopeLogs[0].logRecords[0]", "attributes[{}].value.stringValue"
    return _fields(sinks.to_otlp(Tables(spark, d).raised, host="box"), _OTLP_DOC, nanos=f"{log}.timeUnixNano",
                   number=f"{log}.severityNumber", text=f"{log}.severityText", body=f"{log}.body.stringValue",
                   first=f"{log}.{attribute.format(0)}", fifth=f"{log}.{attribute.format(4)}",
                   service=f"resourceLogs[0].resource.{attribute.format(0)}", host=f"resourceLogs[0].resource.{attribute.format(2)}")


_OTLP = duck(f"""select alert_id, concat(us, '000') nanos, case severity when 'info' then '9' when 'low' then '11' when 'medium' then '13' when 'high' then '17' else '21' end number,
 case severity when 'info' then 'INFO' when 'low' then 'INFO' when 'medium' then 'WARN' when 'high' then 'ERROR' else 'FATAL' end as "text", title body, alert_id as "first",
 case when {_SWAP} then related_host else affected_host end fifth, 'lanwatch' service, 'box' host from raised""", "raised")


def _forward(spark, d):
    t = Tables(spark, d)
    alert = "timestamp: string, title: string, confidence: string"
    out = _fields(sinks.forwardable(t.raised, "attic", "medium"), f"sensor_id string, alert struct<{alert}>",
                  sensor="sensor_id", ts="alert.timestamp", title="alert.title", conf="alert.confidence")
    own = _fields(sinks.export_alerts(t.raised, "critical", "json"), alert.replace(":", ""), ts="timestamp", title="title", conf="confidence")
    return out.unionByName(own.withColumn("sensor", F.lit("-")))


_FORWARD = duck(f"""select alert_id, 'attic' sensor, {_RT} ts, title, cast(cast(confidence as double) as varchar) conf from raised
 where sensor is null and severity in ('medium', 'high', 'critical')
 union all select alert_id, '-', {_RT}, title, cast(cast(confidence as double) as varchar) from raised where severity = 'critical'""", "raised")


def _retention(spark, d):
    t = Tables(spark, d)
    return sinks.keep_recent(t.dns, "us", START + 25 * 86400 * 1_000_000, 10).select("event_id", "us")


_RETENTION = duck(f"select event_id, us from dns where us >= {START + 15 * 86400 * 1_000_000}", "dns")

ENTRIES = {
    "alert_dedup": (_dedup, _DEDUP), "alert_dedup_history": (_dedup_history, _DEDUP_HISTORY), "alert_mutes_quiet_hours": (_mutes, _MUTES),
    "alert_status": (_status, _STATUS), "alert_enrich": (_enrich, _ENRICH), "alert_stats": (_stats, _STATS),
    "incidents": (_incidents, _INCIDENTS), "incident_evidence": (_evidence, _EVIDENCE), "alert_flow": (_alert_flow, _ALERT_FLOW),
    "alert_flow_late": (_late_flow, _ALERT_FLOW), "alert_search": (_search, _SEARCH),
    "suspicion": (_suspicion, _SUSPICION), "suspicion_trend": (_trend, _TREND), "response_plan": (_responses, _RESPONSES),
    "export_cef_syslog": (_cef, _CEF), "export_ecs": (_ecs, _ECS), "export_otlp": (_otlp, _OTLP), "export_forward": (_forward, _FORWARD),
    "retention": (_retention, _RETENTION),
}
