"""Device inventory from ARP claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Config
from ..functions import tables
from ..functions.alerting import cat
from ..functions.net import mac_vendor, normalize_mac


def _rule(text: Column, rules, field: int) -> Column:
    """Value of the first rule whose fragment occurs in the text, null without a match."""
    out = None
    for rule in rules:
        hit = F.instr(text, rule[0]) > 0
        out = F.when(hit, F.lit(rule[field])) if out is None else out.when(hit, F.lit(rule[field]))
    return out


def classify_devices(devices: DataFrame) -> DataFrame:
    """Add `device_type`, `device_type_confidence` and `type_rationale`.

    The gateway is a router; then the first hostname rule decides, then the first vendor rule.
    """
    host, vendor = F.lower(F.coalesce("hostname", F.lit(""))), F.lower(F.coalesce("vendor", F.lit("")))
    named = devices.withColumn("_h", F.struct(
        _rule(host, tables.HOSTNAME_RULES, 1).alias("t"), _rule(host, tables.HOSTNAME_RULES, 0).alias("why")))
    named = named.withColumn("_v", F.struct(
        _rule(vendor, tables.VENDOR_RULES, 1).alias("t"), _rule(vendor, tables.VENDOR_RULES, 0).alias("why"),
        _rule(vendor, tables.VENDOR_RULES, 2).alias("c")))
    gate = F.coalesce("is_gateway", F.lit(False))
    by_host, by_vendor = F.col("_h.t").isNotNull(), F.col("_v.t").isNotNull()
    return (named
            .withColumn("device_type", F.when(gate, "router").when(by_host, F.col("_h.t"))
                        .when(by_vendor, F.col("_v.t")).otherwise("unknown"))
            .withColumn("device_type_confidence", F.when(gate, 0.95).when(by_host, 0.85)
                        .when(by_vendor, F.col("_v.c")).otherwise(0.0))
            .withColumn("type_rationale", F.when(gate, "configured gateway")
                        .when(by_host, cat("hostname matches '", F.col("_h.why"), "'"))
                        .when(by_vendor, cat("vendor matches '", F.col("_v.why"), "'"))
                        .otherwise("no signal"))
            .drop("_h", "_v"))


def name_devices(devices: DataFrame, leases: DataFrame | None,
                 given: DataFrame | None = None) -> DataFrame:
    """Hostname from the DHCP lease of the MAC, else from `given` (ip, name).

    `identity_source` says which; `given` stands for names from another resolver.
    """
    d = devices
    if leases is not None:
        l = leases.select(F.col("mac").alias("_m"), F.nullif("hostname", F.lit("")).alias("_lease"))
        d = d.join(l, d["mac"] == l["_m"], "left").drop("_m")
    else:
        d = d.withColumn("_lease", F.lit(None).cast("string"))
    if given is not None:
        g = given.select(F.col("ip").alias("_ip"), F.nullif("name", F.lit("")).alias("_given"))
        d = d.join(g, d["ip"] == g["_ip"], "left").drop("_ip")
    else:
        d = d.withColumn("_given", F.lit(None).cast("string"))
    return (d.withColumn("hostname", F.coalesce("_lease", "_given", F.lit("")))
            .withColumn("identity_source", F.when(F.col("_lease").isNotNull(), "dhcp")
                        .when(F.col("_given").isNotNull(), "reverse_dns").otherwise(""))
            .drop("_lease", "_given"))


def mark_trusted(devices: DataFrame, cfg: Config) -> DataFrame:
    """Trusted when the address or the MAC is in the configured list."""
    ips, macs = list(cfg.trusted_ips), [m.lower() for m in cfg.trusted_macs]
    trusted = (F.col("ip").isin(ips) if ips else F.lit(False)) | (
        F.col("mac").isin(macs) if macs else F.lit(False))
    return devices.withColumn("is_trusted", trusted)


def device_inventory(arp: DataFrame, cfg: Config = Config(), leases: DataFrame | None = None,
                     given: DataFrame | None = None) -> DataFrame:
    """One row per address: first MAC decides identity, last MAC is current."""
    seen = F.struct("us", "event_id")
    mac = normalize_mac(F.col("src_mac"))
    d = arp.groupBy(F.col("src_ip").alias("ip")).agg(
        F.min_by(mac, seen).alias("mac"), F.max_by(mac, seen).alias("_now"),
        F.min("us").alias("first_seen"), F.max("us").alias("last_seen"))
    d = d.withColumn("vendor", mac_vendor(F.col("mac"))).withColumn(
        "is_gateway", (F.col("ip") == cfg.gateway_ip) | (F.lower("mac") == cfg.gateway_mac.lower()))
    d = classify_devices(mark_trusted(name_devices(d, leases, given), cfg))
    return d.withColumn("mac", F.col("_now")).drop("_now")


def mac_map(devices: DataFrame) -> DataFrame:
    return devices.select("mac", "ip")


def device_count(devices: DataFrame) -> DataFrame:
    return devices.agg(F.count("*").alias("devices"))
