import json

import pytest
from pyspark.sql import functions as F

from lanwatch.config import Config, ResponseConfig
from lanwatch.functions.alerting import ALERT_COLUMNS, ALERT_SCHEMA
from lanwatch.plans import alerts as plans, incidents as inc, reports, responses, scores
from lanwatch.sources import sinks

from .conftest import S, T0

PRE = "cidr string, country string, country_name string, asn int, org string"


@pytest.fixture()
def alerts(spark):
    def make(*items):
        base = dict(severity="medium", category="beacon", affected_host="192.168.1.5", affected_mac="", related_host="",
                    title="t", description="d", recommended_action="", confidence=0.5, confidence_rationale="", status="new",
                    extra="{}", sensor=None)
        out = []
        for i, item in enumerate(items):
            row = {**base, "alert_id": f"a{i:03d}", "dedup_key": "k", **item}
            row["us"] = T0 + int(row.pop("t") * S)
            out.append(tuple(row[c] for c in ALERT_COLUMNS))
        return spark.createDataFrame(out, ALERT_SCHEMA)
    return make


def ids(df):
    return [r.alert_id for r in df.orderBy("alert_id").collect()]


def test_dedup_by_category_with_strict_edge(alerts):
    a = alerts(dict(t=0, category="arp_anomaly"), dict(t=299, category="arp_anomaly"), dict(t=300, category="arp_anomaly"),
               dict(t=600, category="arp_anomaly"), dict(t=901, category="arp_anomaly"))
    assert ids(plans.dedup(a)) == ["a000", "a004"]  # exactly 300 restarts the wait, and so does 600
    b = alerts(dict(t=0, category="threat_intel", severity="critical"), dict(t=119, category="threat_intel", severity="critical"),
               dict(t=121, category="threat_intel", severity="critical"), dict(t=122, category="odd", dedup_key="x"))
    assert ids(plans.dedup(b)) == ["a000", "a002", "a003"]


def test_dedup_history_seeds_the_chain(spark, alerts):
    a = alerts(dict(t=100), dict(t=1801 - 500))
    h = spark.createDataFrame([("k", T0 - 500 * S), ("k", T0 - 9000 * S), ("z", T0)], "dedup_key string, us long")
    assert ids(plans.dedup(a, h)) == ["a001"]


def test_quiet_hours_come_before_dedup(alerts):
    cfg = Config(quiet_enabled=True, quiet_start=23, quiet_end=1)
    a = alerts(dict(t=10, severity="low"), dict(t=20, severity="high"), dict(t=3700, severity="low", dedup_key="x"))
    assert ids(plans.dedup(plans.quiet_hours(a, cfg))) == ["a001", "a002"]


def test_mutes(spark, alerts):
    week = 7 * 86400
    a = alerts(dict(t=0), dict(t=50), dict(t=week + 1799), dict(t=week + 1801), dict(t=60, dedup_key="other"))
    m = spark.createDataFrame([("k", T0 + S)], "dedup_key string, us long")
    assert ids(plans.apply_mutes(a, m)) == ["a000", "a003", "a004"]


def test_enrichment_is_idempotent_and_prefers_related(spark, alerts):
    pre = spark.createDataFrame([("203.0.113.0/24", "US", "United States", 64500, "Alpha"), ("198.51.100.0/24", "", "", 7, "")], PRE)
    a = alerts(dict(t=0, related_host="203.0.113.9", affected_host="198.51.100.1"), dict(t=1, related_host="10.0.0.1", affected_host="198.51.100.1"),
               dict(t=2, extra='{"x":1}', related_host="203.0.113.9"), dict(t=3, related_host="9.9.9.9"))
    once = plans.enrich(a, pre)
    got = {r.alert_id: r for r in plans.enrich(once, pre).collect()}
    assert got["a000"].description == "d [United States, AS64500 Alpha]"
    assert got["a001"].description == "d [AS7]" and json.loads(got["a001"].extra)["enrichment"] == {"ip": "198.51.100.1", "asn": 7, "asn_org": ""}
    assert json.loads(got["a002"].extra)["x"] == 1 and json.loads(got["a002"].extra)["enrichment"]["country"] == "US"
    assert got["a003"].extra == "{}"


def scanner(t, **more):
    return dict(t=t, category="port_scan", related_host="192.168.1.66", severity="low", **more)


def test_incident_by_sensors_and_targets(alerts):
    a = alerts(scanner(0, sensor="a", affected_host="h1"), scanner(300, sensor="b", affected_host="h2"), scanner(301, sensor="b", affected_host="h3"))
    got = inc.incidents(a).collect()
    assert len(got) == 1 and got[0].us == T0 + 300 * S and got[0].severity == "high"  # the far edge belongs to the window
    extra = json.loads(got[0].extra)
    assert extra["sensors"] == ["a", "b"] and extra["event_count"] == 2 and extra["peak_severity"] == "low"
    assert [e["affected_host"] for e in extra["timeline"]] == ["h1", "h2"]
    assert inc.incidents(alerts(scanner(0, sensor="a"), scanner(301, sensor="b"))).count() == 0
    five = alerts(*[scanner(i, affected_host=f"h{i}") for i in range(5)])
    assert json.loads(inc.incidents(five).first().extra)["target_count"] == 5
    three = alerts(*[scanner(i, sensor=s) for i, s in enumerate("abc")])
    assert [r.severity for r in inc.incidents(three).collect()] == ["high"]  # fires at two; the third waits out the cooldown


def stage(t, category, **more):
    host = "192.168.1.66"
    return dict(t=t, category=category, affected_host=host if category != "port_scan" else "LAN",
                related_host="" if category != "port_scan" else host, **more)


def test_intrusion_sequence(alerts):
    story = [stage(0, "new_device"), stage(10, "beacon"), stage(20, "port_scan"), stage(30, "lateral_movement")]
    got = inc.incidents(alerts(*story)).collect()
    assert [r.dedup_key for r in got] == ["incident:sequence:192.168.1.66"] and got[0].confidence == 0.85
    assert json.loads(got[0].extra)["sequence"] == ["new_device", "port_scan", "lateral_movement"]
    wrong = [stage(0, "port_scan"), stage(20, "new_device"), stage(30, "lateral_movement")]
    assert inc.incidents(alerts(*wrong)).count() == 0
    late = [stage(0, "new_device"), stage(200, "port_scan"), stage(301, "lateral_movement")]
    assert inc.incidents(alerts(*late)).count() == 0
    again = [stage(0, "new_device"), stage(100, "new_device"), stage(200, "port_scan"), stage(301, "lateral_movement")]
    assert inc.incidents(alerts(*again)).count() == 1


def test_evidence_as_rows(spark, alerts):
    a = alerts(stage(0, "new_device"), stage(0, "new_device"), stage(10, "beacon"), stage(15, "lateral_movement"), stage(20, "port_scan"),
               stage(25, "new_device"), stage(30, "lateral_movement"), *[scanner(5000 + i, affected_host=f"h{i}") for i in range(6)])
    rows = inc.incident_evidence(a).orderBy("alert_id").collect()
    assert [(r.alert_id, r.stage) for r in rows if r.incident_us == T0 + 30 * S] == [
        ("a000", 1), ("a001", None), ("a002", None), ("a003", None), ("a004", 2), ("a005", None), ("a006", 3)]
    whole = {(r.us, r.dedup_key): r for r in inc.incidents(a).collect()}
    brief = {(r.us, r.dedup_key): r for r in inc.incidents(a, timeline=False).collect()}
    assert whole.keys() == brief.keys() and len(whole) == 2
    for k, w in whole.items():
        b, x, y = brief[k], json.loads(w.extra), json.loads(brief[k].extra)
        assert (w.severity, w.title, w.description, w.confidence_rationale) == (b.severity, b.title, b.description, b.confidence_rationale)
        assert all(x.get(f) == y.get(f) for f in ("event_count", "target_count", "categories", "first_seen", "peak_severity", "sequence"))
        assert "timeline" in x and "timeline" not in y and y.get("sensor_count", 0) == len(x.get("sensors") or [])
    none = spark.createDataFrame([], ALERT_SCHEMA)
    assert inc.incident_evidence(none).count() == 0 and inc.incidents(none, timeline=False).count() == 0


def test_evidence_of_a_busy_actor(spark):
    n = 20_000  # alerts of one actor in one window
    busy = spark.range(0, n, 1, 8).select(
        F.format_string("a%07d", "id").alias("alert_id"), (F.lit(T0) + F.col("id") * 1000).alias("us"), F.lit("low").alias("severity"),
        F.lit("port_scan").alias("category"), F.concat(F.lit("h"), F.col("id")).alias("affected_host"), F.lit("192.168.1.66").alias("related_host"),
        F.lit("t").alias("title"), F.lit("{}").alias("extra"), F.lit("s").alias("sensor"))
    cfg = Config(correlation_targets=n)
    assert inc.incident_evidence(busy, cfg).agg(F.count("*"), F.countDistinct("alert_id")).first()[:] == (n, n)
    got = inc.incidents(busy, cfg, timeline=False)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    row = got.first()
    assert json.loads(row.extra)["event_count"] == n and len(row.extra) < 1000


def test_actor_of_logins(alerts):
    a = alerts(dict(t=0, category="auth_anomaly", affected_host="localhost", related_host="1.1.1.1", extra='{"src_ip":"2.2.2.2"}'),
               dict(t=1, category="auth_anomaly", affected_host="localhost", related_host="1.1.1.1"), dict(t=2, affected_host="", related_host="9.9.9.9"))
    assert [(r.actor, r.target) for r in inc.actor_target(a).orderBy("alert_id").collect()] == [
        ("2.2.2.2", "1.1.1.1"), ("1.1.1.1", None), ("9.9.9.9", None)]


def test_whole_flow_does_not_correlate_incidents(spark, alerts):
    a = alerts(scanner(0, sensor="a", dedup_key="x"), scanner(1, sensor="a", dedup_key="x"), scanner(5, sensor="b", dedup_key="y"))
    out = plans.process(a, Config())
    assert sorted(r.category for r in out.collect()) == ["incident", "port_scan", "port_scan"]
    stats = plans.suppression_stats(a, plans.dedup(a)).first()
    assert (stats.total_processed, stats.total_suppressed, stats.total_fired) == (3, 1, 2)


def test_suspicion_is_capped_and_known_devices_only(spark, alerts):
    a = alerts(*[dict(t=i, severity="critical") for i in range(15)], dict(t=3, affected_host="unknown"))
    devices = spark.createDataFrame([("192.168.1.5", T0)], "ip string, first_seen long")
    bump = spark.createDataFrame([("b", "192.168.1.5", T0, 0.5)], "alert_id string, ip string, us long, delta double")
    pts = scores.suspicion(a, bump, devices)
    got = [r.score for r in scores.history(pts).orderBy("us").collect()]
    assert got[:2] == [pytest.approx(1.3), pytest.approx(2.1)] and got[-1] == 10.0 and len(got) == 15
    trend = scores.suspicion_trend(scores.history(pts), None, 3).collect()
    assert [r.us for r in trend] == [T0 + i * S for i in (12, 13, 14)]
    top = reports.top_suspicious(scores.score_devices(devices, pts)).first()
    assert (top.suspicion_score, top.alert_count) == (10.0, 16)


def test_response_gates(alerts):
    a = alerts(dict(t=0, category="threat_intel", severity="high", related_host="203.0.113.9"),
               dict(t=1, category="threat_intel", severity="high", related_host="Odd.Sample.net."),
               dict(t=2, category="arp_anomaly", severity="critical", extra='{"is_gateway":true}'),
               dict(t=3, category="threat_intel", severity="low", related_host="203.0.113.9"))
    cfg = Config(gateway_ip="192.168.1.1", gateway_mac="aa:bb:cc:00:00:01")
    def plan(**more):
        return {r.responder: r for r in responses.response_plan(a, ResponseConfig(**more), cfg).collect()}
    assert plan(enabled=False) == {}
    dry = plan(enabled=True)
    assert set(dry) == {"firewall", "dns_sinkhole", "arp_restore"} and {r.status for r in dry.values()} == {"planned"}
    assert dry["dns_sinkhole"].target == "odd.sample.net" and dry["arp_restore"].commands == ["arp -s 192.168.1.1 aa:bb:cc:00:00:01"]
    armed = plan(enabled=True, dry_run=False, trusted_categories=("threat_intel",))
    assert (armed["firewall"].status, armed["arp_restore"].status) == ("ready", "pending")
    assert plan(enabled=True, block_min_severity="odd").get("firewall") is None
    custom = plan(enabled=True, custom_command=("run", "{ip}", "{severity}"), custom_categories=("arp_anomaly",))
    assert custom["killswitch"].commands == ["run 192.168.1.5 critical"]


def test_export_formats(alerts):
    a = alerts(dict(t=0, title="a|b\\c", description="x=1\ny", severity="critical", extra='{"n":1}', related_host="8.8.8.8"),
               scanner(1, affected_host="192.168.1.7", affected_mac="m"))
    cef = {r.alert_id: r.value for r in sinks.to_cef(a).collect()}
    assert cef["a000"].startswith("CEF:0|lanwatch|lanwatch|1.0.0|beacon|a\\|b\\\\c|10|externalId=a000 rt=2024-01-02T00:00:00+00:00 cat=beacon src=192.168.1.5")
    assert "msg=x\\=1\\ny cn1=0.5 cn1Label=confidence" in cef["a000"] and "cs1" not in cef["a000"]
    ecs = {r.alert_id: json.loads(r.value) for r in sinks.to_ecs(a).collect()}
    assert ecs["a000"]["lanwatch"]["extra"] == {"n": 1} and ecs["a000"]["event"]["severity"] == 9
    assert ecs["a001"]["source"] == {"ip": "192.168.1.66"} and ecs["a001"]["destination"] == {"ip": "192.168.1.7"}
    assert ecs["a001"]["host"] == {"ip": "192.168.1.7"}
    otlp = json.loads(sinks.to_otlp(a.limit(1)).first().value)["resourceLogs"][0]
    record = otlp["scopeLogs"][0]["logRecords"][0]
    assert record["timeUnixNano"] == str(T0 * 1000) and record["severityNumber"] == 21
    attrs = {x["key"]: x["value"] for x in record["attributes"]}
    assert attrs["lanwatch.confidence"] == {"doubleValue": 0.5} and attrs["lanwatch.extra"] == {"stringValue": '{"n":1}'}
    assert "source.mac" not in attrs and len(otlp["resource"]["attributes"]) == 2
    line = {r.alert_id: r.value for r in sinks.to_syslog_lines(a, "daemon", "", "cef").collect()}["a000"]
    assert line.startswith("<26>1 2024-01-02T00:00:00+00:00 - lanwatch - - - CEF:0|")
    assert sinks.export_alerts(a, "high", "json").count() == 1 and sinks.forwardable(a, "s", "low").count() == 2


def test_alert_table_replace_and_purge(spark, alerts, tmp_path):
    path = str(tmp_path / "alerts")
    a = alerts(dict(t=0), dict(t=86400), dict(t=3 * 86400 + 10), dict(t=3 * 86400 + 7200))
    sinks.write_alerts(a, path)
    sinks.write_alerts(a.where("alert_id = 'a001'").withColumn("status", F.lit("resolved")), path)
    assert {r.alert_id: r.status for r in sinks.read_alerts(spark, path).collect()} == {"a000": "new", "a001": "resolved", "a002": "new", "a003": "new"}
    sinks.purge(spark, path, "us", T0 + (3 * 86400 + 3600 + 30 * 86400) * S, 30)
    spark.catalog.clearCache()
    assert ids(sinks.read_alerts(spark, path)) == ["a003"]


def test_reports(spark, alerts):
    a = alerts(dict(t=0, sensor="garage"), dict(t=1, sensor="garage", severity="high"), dict(t=2, sensor="attic"), dict(t=3))
    assert {r.sensor: r.alert_count for r in reports.sensor_rollup(a).collect()} == {"garage": 2, "attic": 1, "local": 1}
    assert {r.severity: r.cnt for r in reports.alerts_by_severity(a, T0 + S).collect()} == {"high": 1, "medium": 2}
    devices = spark.createDataFrame([("192.168.1.5", T0), ("192.168.1.6", T0 - 90 * 86400 * S)], "ip string, first_seen long")
    daily = {(r.section, r.name): r.value for r in reports.daily_report(a, devices, T0 + 100 * S).collect()}
    assert daily[("total_alerts", "")] == 4 and daily[("new_devices", "192.168.1.5")] == 1 and daily[("top_alerting_hosts", "192.168.1.5")] == 4
    log = spark.createDataFrame([("f", T0, True, None), ("f", T0 + S, False, "boom"), ("g", T0, False, "no")], "feed string, us long, ok boolean, error string")
    fresh = {r.feed: r for r in reports.feed_freshness(log, T0 + 48 * 3600 * S).collect()}
    assert fresh["f"].stale and fresh["f"].last_error == "boom" and fresh["g"].last_success is None
