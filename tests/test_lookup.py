"""Prefix lookups against the address library, and their streaming forms against the batch ones."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from lanwatch import registry
from lanwatch.config import Config
from lanwatch.operators import intel, lookup

from .conftest import CONN, DNS, S, T0

RNG = random.Random(21)


def nested_networks():
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.0.0.0/7", "10.128.0.0/9", "203.0.113.0/24", "203.0.113.128/25", "203.0.113.255/32", "255.255.255.255/32",
            "198.18.0.0/15", "198.18.7.9/16", "::/0", "2001:db8::/32", "2001:db8:1::/48", "2001:db8:1:2::/64", "2001:db8:1:2:3::/80", "2001:db8::1/128",
            "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128", "fe00::/7", "bad/8", "1.2.3.4", "1.2.3.4/40", "1.2.3.0/-1", "2001:db8::/129", ""]
    for _ in range(120):
        nets.append(f"{RNG.choice([10, 11, 198])}.{RNG.choice([0, 18, 19, 128])}.{RNG.randrange(4)}.{RNG.randrange(256)}/{RNG.randint(9, 32)}")
        nets.append(str(ipaddress.ip_address((0x20010DB8 << 96) | (RNG.randrange(4) << 80) | (RNG.randrange(3) << 64) | RNG.randrange(1 << 12))) + f"/{RNG.randint(30, 128)}")
    return nets


def addresses(nets):
    out = ["", None, "text", "1.2.3.4.5", "0.0.0.0", "255.255.255.255", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    for text in nets:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            continue
        for n in (int(net.network_address) - 1, int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1):
            if 0 <= n < 1 << net.max_prefixlen:
                out.append(str((ipaddress.IPv6Address if net.version == 6 else ipaddress.IPv4Address)(n)))
    return sorted(set(out[2:])) + out[:2]


def brute(ip, nets, rank):
    try:
        a = ipaddress.ip_address(ip or "")
    except ValueError:
        return None
    best = None
    for k, text in enumerate(nets):
        try:
            bits = int(text.split("/")[1])
            net = ipaddress.ip_network(text, strict=False)
        except (ValueError, IndexError):
            continue
        if a in net:
            best = min(best or (rank(k, bits), text), (rank(k, bits), text))
    return best[1] if best else None


@pytest.mark.parametrize("first_by", [None, "feed_order"])
def test_best_prefix_of_nested_networks(spark, rows, first_by):
    nets = list(dict.fromkeys(nested_networks()))
    table = rows([(n, (k * 7) % len(nets)) for k, n in enumerate(nets)], "cidr string, feed_order int")
    ips = addresses(nets)
    got = lookup.prefix_match(rows([(i,) for i in ips], "ip string"), "ip", table, ["cidr"], "hit", first_by).collect()
    assert len(got) == len(ips)
    rank = (lambda k, bits: ((k * 7) % len(nets), -bits)) if first_by else (lambda k, bits: -bits)

    def same(a, b):  # equally long networks of one address are one network, written with different host bits
        return a == b or (not first_by and a and b and ipaddress.ip_network(a, strict=False) == ipaddress.ip_network(b, strict=False))
    wrong = [(r.ip, r.hit, brute(r.ip, nets, rank)) for r in got if not same(r.hit and r.hit.cidr, brute(r.ip, nets, rank))]
    assert not wrong, wrong[:5]
    inner = lookup.prefix_match(rows([(i,) for i in ips], "ip string"), "ip", table, ["cidr"], "hit", first_by, how="inner")
    assert inner.count() == sum(r.hit is not None for r in got)


def test_lookups_with_empty_tables(rows):
    df = rows([("10.0.0.1",), (None,)], "ip string")
    prefixes = rows([], "cidr string, country string, country_name string, asn int, org string")
    got = lookup.asn_lookup(lookup.geo_lookup(df, "ip", prefixes), "ip", prefixes).collect()
    assert [tuple(r)[1:] for r in got] == [("", "", 0, "")] * 2
    full = rows([("10.0.0.0/8", "AA", "A", 1, "one")], "cidr string, country string, country_name string, asn int, org string")
    assert lookup.geo_lookup(df.where("false"), "ip", full).count() == 0


INDICATORS = "value string, kind string, source string, category string, feed_order int"
LISTED = [("203.0.113.9", "ip", "f", "c", 1), ("203.0.113.0/24", "cidr", "f", "c", 2), ("203.0.0.0/16", "cidr", "g", "c", 1), ("2001:db8::/32", "cidr", "f", "c", 3),
          ("2001:db8:1::7", "ip", "f", "c", 4), ("bad.example", "domain", "f", "c", 5), ("very.bad.example", "domain", "g", "c", 6), ("net.a.b.c.org", "domain", "f", "c", 7)]


def source(spark, df, path, files=3):
    """The rows as a stream of several micro-batches."""
    for k in range(files):
        df.where(F.col("event_id") % files == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_streamed_indicator_hits_equal_batch(spark, rows, tmp_path):
    targets = ["203.0.113.9", "203.0.113.77", "203.0.5.5", "2001:db8:1::7", "2001:db8:2::1", "198.51.100.1", "", "192.168.1.9"]
    conn = rows([(i, T0 + i * S, f"192.168.1.{i % 5}", targets[i % 8], 443, "tcp", "S", 1) for i in range(80)], CONN)
    names = ["x.very.bad.example", "bad.example", "good.example", "a.net.a.b.c.org", "b.c.org", "", "localhost"]
    dns = rows([(i, T0 + i * S, "192.168.1.3", names[i % 7], "A", False, targets[i % 8]) for i in range(80)], DNS)
    indicators = rows(LISTED, INDICATORS).cache()
    cfg = Config(intel_cooldown=0)
    for name, batch, stream in (
            ("intel_conn", intel.hit_alerts(intel.connection_hits(conn, indicators, cfg)),
             intel.hit_alerts(intel.connection_hits(source(spark, conn, str(tmp_path / "c")), indicators, cfg))),
            ("intel_dns", intel.hit_alerts(intel.dns_hits(dns, indicators, cfg)),
             intel.hit_alerts(intel.dns_hits(source(spark, dns, str(tmp_path / "d")), indicators, cfg)))):
        want = sorted(tuple(r) for r in batch.collect())
        assert len(want) > 20 and collected(stream, tmp_path, name) == want
    from lanwatch.streaming import rules
    both = rules.intel_rules(indicators, conn, dns, cfg)
    streamed = rules.intel_rules(indicators, source(spark, conn, str(tmp_path / "c2")), source(spark, dns, str(tmp_path / "d2")), cfg)
    assert collected(streamed, tmp_path, "intel_both") == sorted(tuple(r) for r in both.collect())


def test_streamed_network_reputation_equals_batch(spark, rows, tmp_path):
    from lanwatch.streaming import rules
    prefixes = rows([("203.0.113.0/24", "AA", "A", 64500, "Bulletproof Ltd"), ("203.0.0.0/16", "AA", "A", 64501, "Plain"),
                     ("2001:db8::/32", "BB", "B", 64502, "Other")], "cidr string, country string, country_name string, asn int, org string").cache()
    targets = ["203.0.113.9", "203.0.5.5", "2600::1", "198.51.100.1"]
    conn = rows([(i, T0 + i * S, "192.168.1.4", targets[i % 4], 443, "tcp", "S", 1) for i in range(40)], CONN)
    prefixes = prefixes.unionByName(rows([("2600::/16", "CC", "C", 64503, "Six")], prefixes.schema)).cache()
    cfg = Config(suspicious_asns=(64503,), asn_cooldown=0)
    want = sorted(tuple(r) for r in rules.asn_rules(conn, prefixes, cfg).collect())
    got = collected(rules.asn_rules(source(spark, conn, str(tmp_path / "a")), prefixes, cfg), tmp_path, "asn")
    assert got == want and any("2600::1" in str(r) for r in want)


def test_registry_runs_detectors_of_several_tables(rows):
    conn = rows([(i, T0 + i * S, "192.168.1.4", "203.0.113.9", 443, "tcp", "S", 1) for i in range(3)], CONN)
    indicators = rows(LISTED, INDICATORS)
    inputs = {"connections": conn, "indicators": indicators}
    assert "intel_hits" in registry.names_for(inputs) and "asn_reputation" not in registry.names_for(inputs)
    got = registry.detect(inputs, Config(), ["intel_hits", "asn_reputation"]).collect()
    assert [r.category for r in got] == ["threat_intel"]
