"""Scenarios with the default thresholds (or the lowered ones noted)."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lanwatch import registry
from lanwatch.config import Config, with_profile
from lanwatch.operators import arp, auth, baseline, beacon, dns, intel, inventory, lookup, profile, scan, volume, windows

from .conftest import ARP, AUTH, CONN, DNS, S, T0

LOW = Config(gateway_ip="192.168.1.1", gateway_mac="aa:bb:cc:00:00:01", scan_ports=5, beacon_intervals=5,
             beacon_cv=0.20, ssh_failures=5, ssh_window=60, fanout_targets=3)


def conn(rows, items, protocol="tcp", flags="S", size=0):
    return rows([(i, T0 + int(t * S), s, d, p, protocol, flags, size) for i, (t, s, d, p) in enumerate(items)], CONN)


def scan_items(n, seconds=30):
    return [(i * seconds / n, "192.168.1.50", "192.168.1.100", i + 1) for i in range(n)]


@pytest.mark.parametrize("n,fires", [(50, True), (2, False)])
def test_port_scan(rows, n, fires):
    got = scan.port_scan(conn(rows, scan_items(n)), LOW).collect()
    assert bool(got) == fires
    if fires:
        a = got[0]
        assert (a.affected_host, a.related_host, a.severity, a.category) == ("192.168.1.100", "192.168.1.50", "low", "port_scan")
        extra = json.loads(a.extra)
        assert extra["unique_ports_count"] == 5 and extra["sample_ports"] == [1, 2, 3, 4, 5]
        assert extra["explanation"]["evidence"][0]["threshold"] == 5.0


def test_port_scan_needs_tcp_syn_and_respects_allowlists(rows):
    assert not scan.port_scan(conn(rows, scan_items(50), flags="A"), LOW).collect()
    assert not scan.port_scan(conn(rows, scan_items(50), protocol="udp"), LOW).collect()
    assert not scan.port_scan(conn(rows, scan_items(50)), LOW.but(allow_ips=("192.168.1.50",))).collect()
    assert scan.port_scan(conn(rows, scan_items(50), flags="SA"), LOW).count() == 1


def test_port_scan_severity_by_breadth(rows):
    got = scan.port_scan(conn(rows, scan_items(120, 1)), LOW.but(scan_ports=60)).collect()
    assert [a.severity for a in got] == ["medium"]


def test_host_sweep_counts_local_targets_only(rows):
    local = [(i, "192.168.1.9", f"192.168.1.{100 + i}", 445) for i in range(16)]
    outside = [(i, "192.168.1.9", f"8.8.8.{i}", 445) for i in range(40)]
    assert scan.host_sweep(conn(rows, local + outside)).count() == 1
    assert scan.host_sweep(conn(rows, outside)).count() == 0


def test_lateral_fanout_and_new_admin_pairs(rows):
    items = [(i, "192.168.1.9", f"192.168.1.{100 + i}", 22 if i % 2 else 445) for i in range(4)]
    a = scan.lateral_fanout(conn(rows, items), LOW).collect()
    assert len(a) == 1 and a[0].dedup_key == "lateral_fanout:192.168.1.9" and json.loads(a[0].extra)["protocols"] == ["SMB", "SSH"]
    assert scan.lateral_fanout(conn(rows, [(i, "192.168.1.9", f"192.168.1.{100 + i}", 8080) for i in range(9)]), LOW).count() == 0
    assert scan.new_admin_pair(conn(rows, items + items), LOW).count() == 4
    known = rows([("192.168.1.9", "192.168.1.100", 445, "tcp"), ("192.168.1.9", "192.168.1.101", 22, "udp")],
                 "src_ip string, dst_ip string, dst_port int, protocol string")
    assert scan.new_admin_pair(conn(rows, items), LOW, destinations=known).count() == 3
    learning = LOW.but(learning_start_us=T0, learning_hours=1)
    assert scan.new_admin_pair(conn(rows, items), learning).count() == 0


def beat(jitter, n=20, period=60, port=4444, seed=4):
    r, t, out = random.Random(seed), 0.0, []
    for _ in range(n):
        out.append((t, "192.168.1.20", "198.51.100.7", port))
        t += period * (1 + r.uniform(-jitter, jitter))
    return out


def test_beacon(rows):
    a = beacon.beacon(conn(rows, beat(0.03)), LOW).collect()
    assert len(a) == 1 and a[0].category == "beacon" and a[0].severity == "high" and a[0].confidence == 0.85
    assert "every ~60s" in a[0].title or "every ~61s" in a[0].title or "every ~59s" in a[0].title
    known = rows([("192.168.1.20", "198.51.100.7", 4444, "tcp")], "src_ip string, dst_ip string, dst_port int, protocol string")
    b = beacon.beacon(conn(rows, beat(0.03)), LOW, known).collect()
    assert (b[0].severity, b[0].confidence) == ("medium", 0.7)


def test_no_beacon(rows):
    r = random.Random(9)
    t, irregular = 0.0, []
    for _ in range(60):
        t += r.expovariate(1 / 60)
        irregular.append((t, "192.168.1.20", "198.51.100.7", 4444))
    assert not beacon.beacon(conn(rows, irregular), LOW.but(beacon_cv=0.1)).collect()
    assert not beacon.beacon(conn(rows, beat(0.01, n=3)), LOW).collect()
    assert not beacon.beacon(conn(rows, beat(0.01, port=443)), LOW).collect()
    assert not beacon.beacon(conn(rows, beat(0.01, period=2)), LOW).collect()
    assert not beacon.beacon(conn(rows, beat(0.01, period=4000)), LOW).collect()  # idle resets the flow


def test_beacon_history_spans_buckets(rows):
    cfg = LOW.but(beacon_history=10, beacon_idle=100, beacon_cooldown=300)
    items = [(i * 60.0, "192.168.1.20", "198.51.100.7", 4444) for i in range(100)]
    one = beacon.flow_gaps(conn(rows, items), cfg).orderBy("us").collect()
    assert [r.intervals for r in one] == [min(i, 9) for i in range(100)]


@pytest.mark.parametrize("history", [2, 7, 200, None])
def test_flow_gaps_against_brute_force(rows, history):
    """Ties, idle gaps, short gaps, a null host, a busy flow over many buckets and blocks."""
    rng, items = random.Random(4), []
    for f, n in ((0, 900), (1, 60), (2, 60), (3, 1)):
        t = T0 + f
        for _ in range(n):
            t += rng.choice([0, 400_000, S, 30 * S, 61 * S + 3, 900 * S, 3600 * S]) if rng.random() < 0.97 else 3600 * S + rng.choice([1, 9000 * S])
            items.append((len(items), t, None if f == 2 else f"192.168.1.{f}", "198.51.100.7", 4444))
    data = rows(items + [(99_999, None, "192.168.1.0", "198.51.100.7", 4444)], "event_id long, us long, src_ip string, dst_ip string, dst_port int")
    cfg = Config(beacon_history=history)
    gaps = beacon.flow_gaps(data, cfg)
    assert "collect_list" not in gaps._jdf.queryExecution().toString()
    got = {r.event_id: tuple(r)[5:] for r in gaps.collect()}
    assert len(got) == len(items)
    for src in {i[2] for i in items}:
        frame, last = [], None
        for event_id, us, *_ in sorted((i for i in items if i[2] == src), key=lambda i: (i[1], i[0])):
            if last is not None and us - last > cfg.beacon_idle * S:
                frame, last = [], None
            frame.append(None if last is None or us - last < cfg.beacon_min_gap * S else (us - last) / S)
            last, frame = us, frame[-(history - 1):] if history else frame
            good = [g for g in frame if g is not None]
            n, mean, sd, low, high = got[event_id]
            assert (n, low, high) == (len(good), min(good, default=None), max(good, default=None))
            assert (mean, sd) == ((None, None) if not good else (pytest.approx(statistics.fmean(good)), pytest.approx(statistics.pstdev(good), abs=1e-6)))


def test_beacon_from_sockets(rows):
    data = [(i, T0 + i * 60 * S, "192.168.1.20", "198.51.100.7", 4444, "ESTABLISHED") for i in range(12)] * 2
    sockets = rows(data, "event_id long, us long, local_ip string, remote_ip string, remote_port int, state string")
    assert beacon.beacon_from_sockets(sockets, LOW).count() == 1


def query(rows, items, kind="A", nx=False):
    return rows([(i, T0 + int(t * S), s, n, kind, nx, "") for i, (t, s, n) in enumerate(items)], DNS)


def test_dns_rates(rows):
    names = [(i * 2 % 60, "192.168.1.30", f"q{i}zz.example.com") for i in range(60)]
    assert dns.nxdomain_rate(query(rows, names, nx=True)).count() == 1
    assert dns.nxdomain_rate(query(rows, names)).count() == 0
    assert dns.dga_rate(query(rows, names)).count() == 1
    assert dns.dga_rate(query(rows, names), Config(allow_domains=("example.com",))).count() == 0


def test_entropy_known_modes(rows):
    q = query(rows, [(0, "h", "x8f3kq9zl2vb7w.com"), (9000, "h", "x8f3kq9zl2vb7w.com"), (1, "h", "google.com"),
                     (2, "h", "x8f3kq9zl2vb7w.cloudfront.net")])
    cfg = Config(entropy_threshold=3.0)
    assert dns.dns_entropy(q, cfg).count() == 1
    assert dns.dns_entropy(q, cfg, known_mode="recorded").count() == 0
    learning = cfg.but(learning_start_us=T0, learning_hours=24)
    assert dns.dns_entropy(q, learning).count() == 2
    known = rows([("x8f3kq9zl2vb7w.com",)], "domain string")
    assert dns.dns_entropy(q, cfg, known).count() == 0


def test_tunnels_and_tlds(rows):
    long = "a" * 60
    q = query(rows, [(0, "h", f"{long}.t.example.com"), (1, "h", f"{long}.t.example.com"), (2, "h", "b" * 30 + ".t.example.com"),
                     (3, "h", "short.example.com"), (4, "h", "c" * 30 + ".com")], kind="TXT")
    assert [a.severity for a in dns.dns_tunnel_label(q).collect()] == ["high"]
    assert [a.dedup_key for a in dns.dns_tunnel_txt(q).collect()] == ["dns_txt_suspicious:example.com"]
    t = query(rows, [(0, "h", "bad.tk"), (1, "h", "bad.tk"), (2, "h", "good.com")])
    assert [a.severity for a in dns.dns_tld(t).collect()] == ["info"]


def test_encrypted_dns(rows):
    items = [(0, "192.168.1.5", "9.9.9.9", 443), (1, "192.168.1.5", "9.9.9.9", 443), (2, "192.168.1.5", "93.184.216.34", 443),
             (3, "192.168.1.5", "203.0.113.5", 853), (4, "8.8.8.8", "9.9.9.9", 443), (5, "192.168.1.5", "192.168.1.1", 853)]
    devices = rows([("192.168.1.5", "laptop")], "ip string, hostname string")
    got = {a.related_host: a for a in dns.encrypted_dns(conn(rows, items), Config(), devices).collect()}
    assert set(got) == {"9.9.9.9", "203.0.113.5"}
    assert got["9.9.9.9"].title == "Encrypted DNS bypass (DoH): 192.168.1.5 (laptop) → Quad9" and got["9.9.9.9"].confidence == 0.6
    assert dns.encrypted_dns(conn(rows, items), Config(sanctioned_resolvers=("9.9.9.9",))).count() == 1


def claim(rows, items):
    return rows([(i, T0 + int(t * S), op, ip, mac) for i, (t, op, ip, mac) in enumerate(items)], ARP)


GOOD, BAD = "aa:bb:cc:00:00:01", "de:ad:be:ef:00:01"


def test_arp_spoof(rows):
    items = [(0, 2, "192.168.1.1", GOOD)] + [(1 + i / 2, 2, "192.168.1.1", BAD) for i in range(10)]
    a = claim(rows, items)
    assert [x.severity for x in arp.arp_conflict(a, LOW).collect()] == ["critical"]
    assert arp.gateway_mac_change(a, LOW).count() == 10  # the known gateway MAC never moves
    assert [json.loads(x.extra)["is_gateway"] for x in arp.mac_change(a, LOW).collect()] == [True]
    devices = rows([("192.168.1.1", GOOD, True)], "ip string, mac string, is_gateway boolean")
    assert arp.arp_conflict(claim(rows, items[1:]), LOW, devices).count() == 1
    assert arp.gateway_mac_change(claim(rows, items[1:]), LOW, devices).count() == 10
    assert arp.gateway_mac_change(claim(rows, items[1:]), LOW).count() == 0


def test_arp_flood_and_churn(rows):
    flood = claim(rows, [(i / 10, 2, f"192.168.1.{i}", BAD) for i in range(25)])
    assert arp.arp_flood(flood).count() == 6
    flip = claim(rows, [(i, 1, "192.168.1.8", GOOD if i % 2 else BAD) for i in range(8)])
    assert arp.arp_churn(flip).count() == 3
    assert arp.arp_flood(claim(rows, [(i, 2, "192.168.1.8", "ff:ff:ff:ff:ff:ff") for i in range(50)])).count() == 0


def test_devices(rows):
    a = claim(rows, [(0, 1, "192.168.1.1", GOOD), (1, 1, "192.168.1.7", "b8:27:eb:00:00:07"), (2, 1, "192.168.1.7", "b8:27:eb:00:00:07")])
    got = {x.affected_host: x for x in arp.new_device(a, LOW.but(trusted_macs=(GOOD.upper(),))).collect()}
    assert list(got) == ["192.168.1.7"] and got["192.168.1.7"].title == "New device appeared: 192.168.1.7 [Raspberry Pi Foundation]"
    leases = rows([("b8:27:eb:00:00:07", "192.168.1.7", "office-printer")], "mac string, ip string, hostname string")
    inv = {d.ip: d for d in inventory.device_inventory(a, LOW, leases).collect()}
    assert inv["192.168.1.1"].device_type == "router" and inv["192.168.1.1"].is_gateway
    assert (inv["192.168.1.7"].device_type, inv["192.168.1.7"].identity_source) == ("printer", "dhcp")


def test_ip_change_forgets_a_displaced_mac(rows):
    m1, m2 = "00:00:00:00:00:11", "00:00:00:00:00:22"
    move = [(0, 1, "10.0.0.1", m1), (1, 1, "10.0.0.2", m1), (2, 1, "10.0.0.1", m1)]
    assert [json.loads(x.extra)["old_ip"] for x in arp.ip_change(claim(rows, move)).collect()] == ["10.0.0.2"]
    gone = move[:2] + [(2, 1, "10.0.0.2", m2), (3, 1, "10.0.0.1", m1)]
    assert not arp.ip_change(claim(rows, gone)).collect()


def login(rows, items):
    return rows([(i, T0 + int(t * S), ip, u, k, c) for i, (t, ip, u, k, c) in enumerate(items)], AUTH)


def test_auth(rows):
    a = login(rows, [(i * 2, "203.0.113.9", "root", "ssh_failure", None) for i in range(50)]
              + [(200, "203.0.113.9", "al", "ssh_success", None), (201, "203.0.113.9", "bo", "ssh_success", None),
                 (202, None, None, "sudo", "/bin/bash"), (203, None, None, "sudo", "/bin/bash"), (204, None, None, "sudo", "/bin/ls"),
                 (205, None, None, "sudo_failure", None), (206, None, "kim", "new_user", None), (207, None, "kim", "new_user", None)])
    brute = auth.ssh_brute_force(a, LOW).orderBy("us").collect()
    assert [json.loads(x.extra)["failure_count"] for x in brute] == [5, 30]
    assert [x.dedup_key for x in auth.new_ssh_source(a, LOW).collect()] == ["new_ssh_login:203.0.113.9:al"]
    assert auth.new_ssh_source(a, LOW, rows([("203.0.113.9",)], "src_ip string")).count() == 0
    assert auth.sudo_sensitive(a).count() == 1
    assert [x.dedup_key for x in auth.sudo_failure(a).collect()] == ["sudo_failure:2024010200"]
    assert auth.new_account(a).count() == 1


INDICATORS = [("203.0.113.71", "ip", "feodo", "botnet_c2", 1), ("198.18.32.0/20", "cidr", "spamhaus_drop", "x", 2),
              ("198.18.32.0/24", "cidr", "spamhaus_drop", "y", 3), ("odd.sample.net", "domain", "urlhaus", "z", 4),
              ("2001:db8::/33", "cidr", "spamhaus_drop", "six", 5)]
IND = "value string, kind string, source string, category string, feed_order int"


def test_intel(rows):
    ind = rows(INDICATORS, IND)
    c = conn(rows, [(0, "192.168.1.5", "203.0.113.71", 443), (1, "192.168.1.6", "203.0.113.71", 443), (2, "192.168.1.5", "198.18.32.5", 1),
                    (3, "192.168.1.5", "198.18.99.5", 1), (4, "192.168.1.5", "2001:db8:1::5", 1), (5, "192.168.1.5", "2001:db8:8000::5", 1)])
    d = rows([(10, T0 + 10 * S, "192.168.1.5", "a.b.odd.sample.net", "A", False, ""), (11, T0 + 11 * S, "192.168.1.5", "xodd.sample.net", "A", False, ""),
              (12, T0 + 12 * S, "192.168.1.5", "example.com", "A", False, "203.0.113.71"), (13, T0 + 7200 * S, "192.168.1.5", "fine.org", "A", False, "203.0.113.71")], DNS)
    got = sorted((json.loads(a.extra)["indicator"], a.related_host) for a in intel.intel_hits(c, d, ind).collect())
    assert got == [("198.18.32.0/20", "198.18.32.5"), ("2001:db8::/33", "2001:db8:1::5"), ("203.0.113.71", "203.0.113.71"),
                   ("203.0.113.71", "203.0.113.71"), ("odd.sample.net", "a.b.odd.sample.net")]


def test_intel_reads_events_once_for_hits_and_few_domains_row_by_row(rows, monkeypatch):
    ind = rows([*INDICATORS, ("Sample.net", "domain", "urlhaus", "wide", 6), ("odd.sample.net", "domain", "urlhaus", "zz", 7)], IND)
    c = conn(rows, [(0, "192.168.1.5", "203.0.113.71", 443)] * 2)
    names = ["a.b.odd.sample.net", "odd.sample.net.", "sample.net", "xodd.sample.net", "net", "", None]
    d = rows([(10 + i, T0 + 7200 * i * S, "192.168.1.5", n, "A", False, "203.0.113.71") for i, n in enumerate(names)], DNS)
    got = intel.intel_hits(c, d, ind)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "Join" in plan  # the kept hits, no event
    few = sorted(map(str, got.collect()))
    matched = lookup.match_domain(d, "query_name", ind).select("event_id", "hit.category")
    assert dict(matched.collect()) == {10: "z", 11: "z", 12: "wide", 13: "wide", 14: None, 15: None, 16: None}
    monkeypatch.setattr(lookup, "FEW", 0)
    assert sorted(map(str, intel.intel_hits(c, d, ind).collect())) == few and len(few) == 11


PREFIXES = [("203.0.113.0/24", "US", "United States", 64500, "Alpha"), ("203.0.113.64/26", "NL", "Netherlands", 64501, "BulletProof BV")]
PRE = "cidr string, country string, country_name string, asn int, org string"


def test_asn_country_and_destinations(rows):
    pre = rows(PREFIXES, PRE)
    c = conn(rows, [(0, "192.168.1.5", "203.0.113.1", 443), (1, "192.168.1.5", "203.0.113.65", 22), (2, "192.168.1.5", "203.0.113.66", 8080)])
    assert [json.loads(a.extra)["asn"] for a in intel.asn_reputation(c, pre).collect()] == [64501]
    assert sorted(a.title for a in profile.new_country(c, pre).collect()) == [
        "New country for 192.168.1.5: Netherlands", "New country for 192.168.1.5: United States"]
    seen = rows([("192.168.1.5", "US")], "src_ip string, country string")
    assert profile.new_country(c, pre, baseline=seen).count() == 1
    got = {a.related_host: (a.severity, a.title) for a in profile.new_destination(c, prefixes=pre).collect()}
    assert got["203.0.113.65"] == ("medium", "New destination: 192.168.1.5 → 203.0.113.65:22 (NL)")
    assert got["203.0.113.66"][0] == "info"  # 8080 is a common port first
    assert profile.new_destination(c, Config(allow_ips=("203.0.113.1",))).count() == 2


def test_active_hours_and_profile(rows):
    hours = conn(rows, [(h * 3600, "192.168.1.5", "192.168.1.6", 80) for h in range(8)])
    got = sorted((json.loads(a.extra)["hour"], json.loads(a.extra)["known_hours"]) for a in profile.active_hours(hours).collect())
    assert got == [(6, 6), (7, 7)]
    ports = conn(rows, [(i, "192.168.1.5", "192.168.1.6", 1000 + i) for i in range(10)])
    assert [json.loads(a.extra)["value"] for a in profile.off_profile(ports).orderBy("us").collect()] == ["1008", "1009"]
    base = rows([("192.168.1.5", "dst_port", str(i)) for i in range(7)], "src_ip string, dimension string, value string")
    assert profile.off_profile(ports, baseline=base).count() == 9
    sizes = [(i, T0 + i, "192.168.1.5", "8.8.8.8", 0, "tcp", "", s) for i, s in enumerate([10, 2000, 20_000, 10, 200_000])]
    assert [json.loads(a.extra)["value"] for a in profile.off_profile(rows(sizes, CONN)).collect()] == ["100K-1M"]


def test_listeners(rows):
    sock = rows([(1, T0, "0.0.0.0", 22, "LISTEN", "tcp", "sshd", 1), (2, T0 + S, "0.0.0.0", 22, "LISTEN", "tcp", "sshd", 1),
                 (3, T0 + S, "0.0.0.0", 4444, "LISTEN", "tcp", "nc", 2), (4, T0 + 2 * S, "127.0.0.1", 9999, "LISTEN", "tcp", None, None),
                 (5, T0 + 2 * S, "1.1.1.1", 5555, "ESTABLISHED", "tcp", "x", 3)],
                "event_id long, us long, local_ip string, local_port int, state string, protocol string, process_name string, pid int")
    got = {a.dedup_key: (a.severity, a.title) for a in profile.new_listener(sock).collect()}
    assert got == {"new_listen:4444": ("medium", "New listening port: 4444/tcp (nc)"), "new_listen:9999": ("low", "New listening port: 9999/tcp (unknown)")}


def test_spikes(rows):
    quiet = [(m * 60 + i, "192.168.1.5", "8.8.8.8", 80) for m in range(10) for i in range(2)]
    burst = [(600 + i / 10, "192.168.1.5", "8.8.8.8", 80) for i in range(60)]
    a = volume.connection_spike(conn(rows, quiet + burst)).collect()
    assert len(a) == 1 and json.loads(a[0].extra)["connection_count"] == 60
    assert volume.connection_spike(conn(rows, quiet)).count() == 0
    counters = rows([(T0 + i * 60 * S, "eth0", i * 1000 if i < 8 else 100_000 + i, 0) for i in range(9)], "us long, name string, rx_bytes long, tx_bytes long")
    rate = volume.iface_rate(counters)
    assert volume.traffic_spike(rate).count() == 1
    reset = rows([(T0, "e", 500, 0), (T0 + 60 * S, "e", 30, 0)], "us long, name string, rx_bytes long, tx_bytes long")
    assert volume.iface_rate(reset).first().bytes_per_minute == 30


def test_rates_of_snapshots_at_one_time(rows):
    schema = "event_id long, us long, name string, rx_bytes long, tx_bytes long"
    seen = [(i, T0 + i * 60 * S, "eth0", i * i * 10, 0) for i in range(8)]
    again = [(20, T0 + 7 * 60 * S, "eth0", 500, 10), (21, T0 + 7 * 60 * S, "eth0", 505, 5), (30, T0 + 8 * 60 * S, "eth0", 520, 0)]
    rate = volume.iface_rate(rows([*reversed(again), *seen], schema))
    got = sorted(((r.us - T0) // (60 * S), r.bytes_per_minute) for r in rate.collect())
    assert [v for _, v in got[:7]] == [10, 30, 50, 70, 90, 110, 130] and got[-1] == (8, 10)
    assert sorted(map(str, (v for m, v in got if m == 7))) == ["130.0", "inf", "nan"]
    alerts = {((a.us - T0) // (60 * S), json.loads(a.extra)["bytes_per_minute"]): a for a in volume.traffic_spike(rate).collect()}
    # the infinite rate, and what has it in its history; finite rates before it are judged as without it
    assert set(alerts) == {(7, "Infinity"), (7, "NaN"), (8, 10.0)}
    assert "Infinity" in alerts[7, "Infinity"].description and "10 bytes" in alerts[8, 10.0].description
    plain = {r.event_id: r for r in windows.earlier_moments(rows([(i, i * S, "k", float(v)) for i, v in enumerate([1, 3, "inf", 5])],
                                                                  "event_id long, us long, k string, v double"), "k", "v").collect()}
    assert (plain[2].samples, plain[2].mean, plain[2].sd) == (2, 2.0, 1.0) and str(plain[3].mean) == "inf" and str(plain[3].sd) == "nan"


def test_stats_known_values(rows):
    df = rows([("a", float(v)) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "k string, v double")
    s = baseline.stats_agg(df, ["k"], "v")
    assert s.select(baseline.stddev(F.col("n"), F.col("m2"))).first()[0] == pytest.approx(2.0)
    parts = [rows([("a", float(v)) for v in p], "k string, v double") for p in ((2, 4, 4), (4, 5, 5, 7, 9))]
    m = baseline.stats_merge(*[baseline.stats_agg(p, ["k"], "v") for p in parts], ["k"]).first()
    assert (m.n, m.mean, m.m2) == (8, pytest.approx(5.0), pytest.approx(32.0))


def test_profiles_and_registry(rows):
    assert with_profile(Config(), "aggressive").scan_ports == 8 and with_profile(Config(), "conservative").fanout_targets == 10
    assert with_profile(Config(), "balanced") == Config() == with_profile(Config(), "odd")
    registry.register("everything", "connections", lambda df, cfg: scan.canary_hits(df, cfg.but(canary_ports=(7,))))
    try:
        c = conn(rows, scan_items(20))
        out = registry.detect({"connections": c}, LOW, ["port_scan", "everything", "arp_flood"])
        assert sorted(r.category for r in out.collect()) == ["honeypot", "port_scan"]
    finally:
        del registry.DETECTORS["everything"]
