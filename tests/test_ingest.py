from pyspark.sql import functions as F

from lanwatch.sources import events, lines


def text(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, line_no long")


FLOW = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")


def flows(df):
    return [tuple(r) for r in df.orderBy("line_no").select(*FLOW).collect()]


def test_conntrack(spark):
    got = flows(lines.ingest_conntrack(text(
        spark, "tcp      6 431999 ESTABLISHED src=172.20.4.8 dst=198.51.100.61 sport=40017 dport=8883 src=198.51.100.61 dst=203.0.113.2 sport=8883 dport=40017",
        "ipv4     2 tcp      6 117 ESTABLISHED src=172.20.4.9 dst=198.51.100.62 sport=39001 dport=993 src=198.51.100.62 dst=172.20.4.9",
        "icmp 1 29 src=172.20.4.9 dst=172.20.4.1 type=8", "conntrack v9.9.9: 12 flow entries have been shown.", "", "gre 47 src=1.1.1.1 dst=2.2.2.2")))
    assert got == [("172.20.4.8", 40017, "198.51.100.61", 8883, "tcp"), ("172.20.4.9", 39001, "198.51.100.62", 993, "tcp"),
                   ("172.20.4.9", 0, "172.20.4.1", 0, "icmp")]


def test_filterlog(spark):
    v4 = "31,,,77001,em4,match,pass,out,4,0x0,,57,20202,0,DF,6,tcp,48,172.20.4.8,198.51.100.61,40017,8883,0,S"
    got = flows(lines.ingest_filterlog(text(
        spark, "Jan  1 00:00:00 fw filterlog[123]: " + v4, v4,
        "filterlog[1]: 7,,,1,igb1,match,block,in,6,0x00,0x00000,64,UDP,17,53,fe80::1,fe80::2,5353,5353",
        "7,,,1,igb1,match,pass,out,4,0x0,,64,1,0,DF,1,icmp,84,172.20.4.8,198.51.100.99,request,1", "filterlog no colon", "a,b", "",
        "7,,,1,igb1,match,pass,out,5,0x0", "7,,,1,igb1,match,pass,out,4,0x0,,64,1,0,DF,6,tcp,60,,198.51.100.99,1,2")))
    assert got == [("172.20.4.8", 40017, "198.51.100.61", 8883, "tcp")] * 2 + [
        ("fe80::1", 5353, "fe80::2", 5353, "udp"), ("172.20.4.8", 0, "198.51.100.99", 0, "icmp")]


def test_flow_export(spark):
    df = spark.createDataFrame([("a", "b", 6), ("a", "", 6), ("a", "b", 47)], "src_ip string, dst_ip string, protocol_number int")
    assert [r.protocol for r in lines.ingest_flow_export(df).collect()] == ["tcp", "47"]


def test_auth_log_order_of_patterns_and_year(spark):
    log = text(
        spark, "Jan  3 04:05:06 h sshd[1]: Failed password for invalid user bob from 1.2.3.4 port 22",
        "Jan  3 04:05:07 h sshd[1]: Invalid user eve from 1.2.3.5", "Dec 31 23:59:59 h sshd[1]: Accepted publickey for al from 1.2.3.6 port 1",
        "Jan  3 04:05:08 h sudo: al : COMMAND=/bin/bash", "Jan  3 04:05:09 h sudo: pam: authentication failure; user=x",
        "Jan  3 04:05:10 h useradd[1]: new user: name=kim,", "Jan  3 04:05:11 h cron: nothing")
    now = 1_704_600_000 * 1_000_000  # 2024-01-07
    got = [(r.event_kind, r.usr, r.src_ip, r.command, r.us) for r in lines.ingest_auth_log(log, 2024, now).orderBy("line_no").collect()]
    t = 1_704_254_706 * 1_000_000
    assert got == [("ssh_failure", "bob", "1.2.3.4", None, t), ("ssh_failure", "eve", "1.2.3.5", None, t + 1_000_000),
                   ("ssh_success", "al", "1.2.3.6", None, 1_704_067_199 * 1_000_000), ("sudo", None, None, "/bin/bash", t + 2_000_000),
                   ("sudo_failure", None, None, None, t + 3_000_000), ("new_user", "kim,", None, None, t + 4_000_000)]


def test_feed_files(spark, tmp_path):
    (tmp_path / "a").write_text("# header\n203.0.113.71\n198.51.100.17 extra\n\n")
    (tmp_path / "b").write_text("; head\n198.18.32.0/20 ; SBL700001\nnonsense/99 ; x\n2001:db8::/32 ; y\n")
    (tmp_path / "c").write_text("# urls\nhttps://me:word@Odd.Sample.net:8443/q/r\nhttp://203.0.113.71/x\n")
    got = lines.load_indicators(spark, {"feodo": str(tmp_path / "a"), "unknown": "nowhere",
                                        "spamhaus_drop": str(tmp_path / "b"), "urlhaus": str(tmp_path / "c")})
    assert sorted((r.value, r.kind, r.source) for r in got.collect()) == [
        ("198.18.32.0/20", "cidr", "spamhaus_drop"), ("198.51.100.17", "ip", "feodo"), ("2001:db8::/32", "cidr", "spamhaus_drop"),
        ("203.0.113.71", "ip", "urlhaus"), ("odd.sample.net", "domain", "urlhaus")]
    assert {r.kind: r.indicators for r in lines.indicator_counts(got).collect()} == {"ip": 2, "cidr": 2, "domain": 1}


def test_dhcp_formats(spark, tmp_path):
    (tmp_path / "d").write_text("1700 AA-BB-CC-00-00-01 192.168.1.5 phone 01\n1700 aa:bb:cc:00:00:02 192.168.1.6 * *\nshort line\n"
                                "1800 aa:bb:cc:00:00:01 192.168.1.7 phone2 01\n")
    got = lines.ingest_dhcp(events.read_lines(spark, str(tmp_path / "d")))
    assert sorted(tuple(r) for r in got.collect()) == [("aa:bb:cc:00:00:01", "192.168.1.7", "phone2"), ("aa:bb:cc:00:00:02", "192.168.1.6", "")]
    block = 'lease 192.168.1.{} {{\n  starts 4;\n  hardware ethernet aa:bb:cc:00:00:0{};\n{}}}\n'
    (tmp_path / "i").write_text("# file\n" + block.format(5, 1, '  client-hostname "old";\n') + block.format(6, 2, "")
                                + "lease 1.1.1.1 {\n}\n" + block.format(8, 1, '  client-hostname "new";\n'))
    got = lines.ingest_dhcp(events.read_lines(spark, str(tmp_path / "i"), "}"), "isc")
    assert sorted(tuple(r) for r in got.collect()) == [("aa:bb:cc:00:00:01", "192.168.1.8", "new"), ("aa:bb:cc:00:00:02", "192.168.1.6", "")]


def test_sensor_messages(spark):
    msg = spark.createDataFrame([
        ('{"sensor_id":"attic","alert":{"alert_id":"x","timestamp":"2024-01-02T00:00:00+00:00","severity":"high","category":"beacon",'
         '"affected_host":"h","title":"t","confidence":0.7,"extra":{"a":1}}}',),
        ('{"alert":{"severity":"huge","category":"none","timestamp":"soon","confidence":0}}',), ('{"sensor_id":"a"}',), ("junk",)], "value string")
    got = {r.sensor: r for r in lines.ingest_sensor_alerts(msg, F.lit(5).cast("bigint")).collect()}
    assert set(got) == {"attic", "unknown"}
    a, b = got["attic"], got["unknown"]
    assert (a.alert_id, a.us, a.severity, a.confidence, a.dedup_key, a.extra) == ("x", 1_704_153_600_000_000, "high", 0.7, "beacon:h:t", '{"a":1}')
    assert (b.us, b.severity, b.category, b.confidence) == (5, "info", "system", 1.0)


def test_snapshot_difference_re_emits_on_return(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (3, "b"), (3, "b")], "us long, f string")
    assert sorted(tuple(r) for r in events.new_in_snapshot(df, ["f"], "us").collect()) == [(2, "c"), (3, "b")]


def test_read_and_stream_schemas(spark, tmp_path):
    path = str(tmp_path / "arp")
    spark.sql("select timestamp'2024-01-02 00:00:00' ts, 2 op, 'm' src_mac, 'i' src_ip, 'x' dst_mac, 'y' dst_ip").write.parquet(path)
    batch = events.read_events(spark, "arp", path)
    assert batch.first().us == 1_704_153_600_000_000
    assert events.stream_events(spark, "arp", path).schema.names == batch.schema.names


def test_dns_and_arp_clean_up(spark):
    d = spark.createDataFrame([("WWW.Example.com.", "28"), ("a.b", "1"), (".x.yz.", "TXT"), ("long.name", "257")], "query_name string, query_type string")
    assert [tuple(r) for r in events.normalise_dns(d).collect()] == [("www.example.com", "AAAA"), ("x.yz", "TXT"), ("long.name", "257")]
    a = spark.createDataFrame([(1, 5, "10.0.0.1", "00-00-00-00-00-00"), (2, 5, "10.0.0.2", "AA:BB:CC:00:00:01")], "event_id long, us long, ip string, mac string")
    assert [(r.op, r.src_mac) for r in events.arp_from_snapshot(a).collect()] == [(2, "aa:bb:cc:00:00:01")]
