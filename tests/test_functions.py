import ipaddress
import math

import pytest
from pyspark.sql import functions as F

from lanwatch.functions import alerting, moments, names, net


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


ADDRESSES = ["10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.9", "127.0.0.1", "169.254.3.4", "224.0.0.1",
             "239.1.1.1", "255.255.255.255", "8.8.8.8", "0.0.0.0", "1.2.3", "1.2.3.256", "01.2.3.4", "", "host",
             "::1", "::", "fe80::1", "fd00::5", "2001:db8::1", "2606:4700::1111", "2001:db8:::1", "1:2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7:8:9", "::ffff:10.0.0.1", "2002::1", "2001:4860:4860::8888", "fe80::1%eth0", "12345::",
             "1::2::3", "64:ff9b::8.8.8.8", "100::1", "g::1", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7::"]


def parsed(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_address_validity_matches_the_standard_library(spark):
    assert column(spark, ADDRESSES, net.is_valid_ip) == [parsed(a) is not None for a in ADDRESSES]


def test_address_bits(spark):
    want = []
    for a in ADDRESSES:
        p = parsed(a)
        want.append(None if p is None else f"{int(p):0{8 if p.version == 4 else 32}x}")
    assert column(spark, ADDRESSES, net.ip_hex) == want


def test_private_addresses(spark):
    def private(text):
        p = parsed(text)
        if p is None:
            return False
        if p.version == 6:
            return p.is_private or p.is_loopback or p.is_link_local
        return any(p in ipaddress.ip_network(n) for n in (
            "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4",
            "255.255.255.255/32"))
    assert column(spark, ADDRESSES, net.is_private_ip) == [private(a) for a in ADDRESSES]


@pytest.mark.parametrize("cidrs", [["192.168.1.0/24"], ["10.0.0.0/8", "172.16.0.0/12"], ["8.8.8.8/32", "fe80::/10"],
                                   ["2001:db8::/33", "169.254.3.4/31"], []])
def test_subnet_membership(spark, cidrs):
    def inside(text):
        p = parsed(text)
        nets = [ipaddress.ip_network(c, strict=False) for c in cidrs]
        return p is not None and any(p.version == n.version and ipaddress.ip_address(int(p)) in n if p.version == 4
                                     else p.version == n.version and int(p) >> (128 - n.prefixlen) == int(
                                         n.network_address) >> (128 - n.prefixlen) for n in nets)
    assert column(spark, ADDRESSES, lambda c: net.ip_in_subnets(c, cidrs)) == [inside(a) for a in ADDRESSES]


def test_macs_and_vendors(spark):
    macs = ["B8-27-EB-00-11-22", "b827eb001122", "b8:27:eb:00:11:2", "xx"]
    assert column(spark, macs, net.normalize_mac) == ["b8:27:eb:00:11:22"] * 2 + ["b8:27:eb:00:11:2", "xx"]
    assert column(spark, macs, net.mac_vendor)[:2] == ["Raspberry Pi Foundation"] * 2
    assert column(spark, ["de:ad:be:ef:00:00"], net.mac_vendor) == [""]


def test_byte_buckets(spark):
    sizes = [0, 999, 1000, 9999, 10_000, 99_999, 1_000_000, 9_999_999, 10_000_000]
    assert column(spark, sizes, net.byte_bucket, "long") == [
        "0-1K", "0-1K", "1K-10K", "1K-10K", "10K-100K", "10K-100K", "1M-10M", "1M-10M", "10M+"]


def test_entropy(spark):
    def entropy(name):
        label = name.lower().split(".")[0]
        return -sum(label.count(c) / len(label) * math.log2(label.count(c) / len(label)) for c in set(label)) if label else 0
    ns = ["google.com", "aaaa.com", "x8f3kq9zl2.net", "", ".com", "a", "Ünïcode.de"]
    assert column(spark, ns, names.label_entropy) == pytest.approx([entropy(n) for n in ns])


def test_domain_functions(spark):
    assert column(spark, ["a.b.evil.com", "com", "evil.com", ""], names.domain_suffixes) == [
        ["a.b.evil.com", "b.evil.com", "evil.com"], [], ["evil.com"], []]
    assert column(spark, ["x.tk", "tk", "a.tk.com", "A.XYZ"], names.suspicious_tld) == [True, False, False, True]
    assert column(spark, ["evil.com", "a.evil.com", "notevil.com"], lambda c: names.domain_in_list(c, ["evil.com"])) == [
        True, True, False]
    assert column(spark, ["d1.cloudfront.net", "xcloudfront.net", "cloudfront"], names.on_cdn) == [True, True, False]


def test_url_hosts(spark):
    urls = ["https://me:word@Odd.Sample.net:8443/q/r", "http://1.2.3.4/x", "plain.host/x@y", "ftp://h:21", "a@b@c", "http:///x"]
    assert column(spark, urls, names.url_host) == ["odd.sample.net", "1.2.3.4", "plain.host", "h", "b@c", ""]


def test_time_functions(spark):
    us = [0, 1_704_067_200_000_000, 1_704_067_200_000_000 + 23 * 3_600_000_000 + 5, -1]
    assert column(spark, us, moments.hour_of_day, "long") == [0, 0, 23, 23]
    assert column(spark, us, moments.weekday, "long") == [3, 0, 0, 2]
    assert column(spark, us[1:3], moments.iso_utc, "long") == [
        "2024-01-01T00:00:00+00:00", "2024-01-01T23:00:00.000005+00:00"]
    assert column(spark, us, lambda c: moments.in_quiet_hours(c, 23, 7), "long") == [True] * 4
    assert column(spark, us[2:3], lambda c: moments.in_quiet_hours(c, 8, 23), "long") == [False]


def test_z_score_on_flat_history(spark):
    got = column(spark, [3.0, 1.0], lambda c: moments.z_score(c, F.lit(2.0), F.lit(0.0)), "double")
    assert got == [1.0, 1.0]


def test_severities(spark):
    s = ["info", "critical", "odd"]
    assert column(spark, s, alerting.severity_rank) == [0, 4, None]
    assert column(spark, s, lambda c: alerting.at_least(c, "high")) == [False, True, None]
    assert column(spark, s, lambda c: alerting.at_least(c, "nonsense")) == [False, False, False]
