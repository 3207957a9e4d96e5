"""ARP detections and the device events that follow from address claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SECOND, Config
from ..functions.alerting import cat, evidence, explain, to_alerts
from ..functions.net import mac_vendor
from .firsts import first_rows
from .lookup import not_allowed
from .windows import previous_value, sliding_count


def claims(arp: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Usable ARP rows: address and MAC present, MAC neither zero nor broadcast, not allowlisted."""
    ip, mac = F.col("src_ip"), F.col("src_mac")
    return arp.where((ip != "") & (mac != "")
                     & ~mac.isin("00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff")
                     & not_allowed(ip, cfg.allow_ips)).select("event_id", "us", "op", "src_ip", "src_mac")


def arp_conflict(arp: DataFrame, cfg: Config = Config(), devices: DataFrame | None = None) -> DataFrame:
    """An address claimed by another MAC than last time; `devices` seeds the first claim."""
    rows = previous_value(claims(arp, cfg), "src_ip", "src_mac", "old_mac")
    if devices is not None:
        seed = devices.select(F.col("ip").alias("src_ip"), F.col("mac").alias("_seed"))
        rows = (rows.join(seed, "src_ip", "left")
                .withColumn("old_mac", F.coalesce("old_mac", "_seed")).drop("_seed"))
    ip, mac, old = F.col("src_ip"), F.col("src_mac"), F.col("old_mac")
    gateway = ip == cfg.gateway_ip
    return to_alerts(
        rows.where(old != mac), category="arp_anomaly",
        severity=F.when(gateway, "critical").otherwise("high"), affected=ip, mac=mac,
        confidence=0.9, dedup_key=cat("arp_conflict:", ip, ":", mac),
        title=cat("ARP conflict: ", ip, " claimed by new MAC ", mac),
        description=cat(ip, " moved from ", old, " [", _vendor(old), "] to ", mac, " [", _vendor(mac), "]."),
        action="Compare both MAC addresses with the DHCP table of the router.",
        rationale="conflicting claims seen directly",
        extra={"known_mac": old, "new_mac": mac, "is_gateway": gateway},
        explanation=explain(evidence("arp_mac_for_ip", mac, comparison="conflicts-with",
                                     baseline=cat("known MAC ", old, " for ", ip)),
                            basis="0.9 for conflicting claims"))


def _vendor(mac):
    return F.coalesce(F.nullif(mac_vendor(mac), F.lit("")), F.lit("unknown"))


def gateway_mac_change(arp: DataFrame, cfg: Config = Config(),
                       devices: DataFrame | None = None) -> DataFrame:
    """Gateway address claimed by a MAC other than the first known one, which never changes."""
    rows = claims(arp, cfg).where(F.col("src_ip") == cfg.gateway_ip)
    first = first_rows(rows, ["src_ip"]).select("src_ip", F.col("src_mac").alias("old_mac"))
    if devices is not None:
        known = (devices.where("is_gateway").groupBy(F.lit(cfg.gateway_ip).alias("src_ip"))
                 .agg(F.max("mac").alias("_known")))
        first = (first.join(known, "src_ip", "left")
                 .withColumn("old_mac", F.coalesce("_known", "old_mac")).drop("_known"))
    ip, mac, old = F.col("src_ip"), F.col("src_mac"), F.col("old_mac")
    return to_alerts(
        rows.join(first, "src_ip").where(mac != old), category="arp_anomaly", severity="critical",
        affected=ip, mac=mac, confidence=0.95, dedup_key=cat("gateway_mac_change:", ip),
        title=cat("CRITICAL: Gateway MAC changed from ", old, " to ", mac),
        description=cat("Gateway ", ip, " now answers from ", mac, " [", _vendor(mac), "], before from ",
                        old, " [", _vendor(old), "]."),
        action="Check the MAC on the gateway itself and look for a new device.",
        rationale="differs from the first known gateway MAC",
        extra={"old_mac": old, "new_mac": mac},
        explanation=explain(evidence("gateway_mac", mac, comparison="changed-from",
                                     baseline=cat("first known gateway MAC ", old)),
                            basis="0.95 for a changed gateway MAC"))


def arp_flood(arp: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Replies per MAC in the window reach the threshold; repeats are left to the alert dedup."""
    rows = claims(arp, cfg).where("op = 2").drop("op")
    counted = sliding_count(rows, ["src_mac"], cfg.flood_window * SECOND, "replies")
    ip, mac, n = F.col("src_ip"), F.col("src_mac"), F.col("replies")
    return to_alerts(
        counted.where(n >= cfg.flood_replies), category="arp_anomaly", severity="high",
        affected=ip, mac=mac, confidence=0.85, dedup_key=cat("arp_flood:", mac),
        title=cat("ARP reply flood from ", mac),
        description=cat(mac, " sent ", n, f" ARP replies in {cfg.flood_window} s."),
        action=cat("Find the device with MAC ", mac, "."),
        rationale=cat(n, f" replies in {cfg.flood_window} s"),
        extra={"reply_count_10s": n},
        explanation=explain(evidence("arp_replies_10s", n, F.lit(cfg.flood_replies), ">=",
                                     f"replies allowed in {cfg.flood_window} s"),
                            basis="0.85 once the reply threshold is reached"))


def sightings(arp: DataFrame) -> DataFrame:
    """Claims with the address's previous MAC (`old_mac`, null on the first claim)."""
    return previous_value(arp.select("event_id", "us", "src_ip", "src_mac"),
                          "src_ip", "src_mac", "old_mac")


def mac_changes(arp: DataFrame) -> DataFrame:
    return sightings(arp).where(F.col("old_mac") != F.col("src_mac"))


def new_device(arp: DataFrame, cfg: Config = Config(), devices: DataFrame | None = None) -> DataFrame:
    """First claim of an address, unless the address or its MAC is trusted.

    `devices` (the built inventory) adds hostname, vendor and type to the title.
    """
    ip, mac = F.col("src_ip"), F.col("src_mac")
    fresh = first_rows(arp.select("event_id", "us", "src_ip", "src_mac"), ["src_ip"]).where(
        not_allowed(ip, cfg.trusted_ips) & not_allowed(mac, [m.lower() for m in cfg.trusted_macs]))
    fresh = fresh.withColumn("vendor", mac_vendor(mac))
    if devices is not None:
        info = devices.select(F.col("ip").alias("src_ip"), "hostname", "device_type")
        fresh = fresh.join(info, "src_ip", "left")
    else:
        fresh = fresh.withColumn("hostname", F.lit("")).withColumn("device_type", F.lit("unknown"))
    kind = F.coalesce("device_type", F.lit("unknown"))
    host = F.when(F.coalesce("hostname", F.lit("")) != "", cat(" (", F.col("hostname"), ")")).otherwise("")
    vendor = F.when(F.col("vendor") != "", cat(" [", F.col("vendor"), "]")).otherwise("")
    looks = F.when(kind != "unknown", cat(" — looks like a ", F.replace(kind, F.lit("_"), F.lit(" ")))).otherwise("")
    return to_alerts(
        fresh, category="new_device", severity="low", affected=ip, mac=mac, confidence=1.0,
        dedup_key=cat("new_device:", ip, ":", mac),
        title=cat("New device appeared: ", ip, host, vendor, looks),
        description=cat("First sight of ", ip, " with MAC ", mac, vendor, host, looks, "."),
        action="Verify that you know this device.", rationale="first claim of this address")


def mac_change(arp: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A known address now has another MAC."""
    first = first_rows(arp.select("event_id", "us", "src_ip", "src_mac"), ["src_ip"]).select(
        "src_ip", F.col("src_mac").alias("first_mac"))
    rows = mac_changes(arp).join(first, "src_ip", "left")
    ip, mac, old = F.col("src_ip"), F.col("src_mac"), F.col("old_mac")
    gateway = (ip == cfg.gateway_ip) | (F.lower("first_mac") == cfg.gateway_mac.lower())
    return to_alerts(
        rows, category="arp_anomaly", severity=F.when(gateway, "critical").otherwise("high"),
        affected=ip, mac=mac, confidence=0.85, dedup_key=cat("mac_change:", ip),
        title=cat(F.when(gateway, "GATEWAY ").otherwise(""), "MAC address changed: ", ip),
        description=cat("The MAC of ", ip, " went from ", old, " [", _vendor(old), "] to ", mac,
                        " [", _vendor(mac), "]."),
        action="Verify the MAC on the device itself.", rationale="another MAC for a known address",
        extra={"old_mac": old, "new_mac": mac, "is_gateway": gateway})


def ip_change(arp: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A known MAC turns up at another, already known address whose MAC did not just change.

    A MAC's address is forgotten when another MAC displaces it, and learned again only from a
    first sighting or a MAC change.
    """
    seen = sightings(arp).withColumn(
        "setter", F.when(F.col("old_mac").isNull() | (F.col("old_mac") != F.col("src_mac")), "set"))
    displaced = seen.where(F.col("old_mac") != F.col("src_mac")).select(
        "event_id", "us", F.lit(None).cast("string").alias("src_ip"),
        F.col("old_mac").alias("src_mac"), F.lit(None).cast("string").alias("old_mac"),
        F.lit("clear").alias("setter"))
    log = seen.select(*displaced.columns).unionByName(displaced)
    state = previous_value(previous_value(log, "src_mac", "setter", "last_setter"),
                           "src_mac", "src_ip", "old_ip")
    ip, mac, old = F.col("src_ip"), F.col("src_mac"), F.col("old_ip")
    moved = state.where((F.col("old_mac") == mac) & (F.col("last_setter") == "set") & (old != ip))
    return to_alerts(
        moved, category="arp_anomaly", severity="medium", affected=ip, mac=mac, confidence=0.7,
        dedup_key=cat("ip_change:", mac),
        title=cat("Device IP changed: ", mac, " was ", old, ", now ", ip),
        description=cat("MAC ", mac, " moved from ", old, " to ", ip, "."),
        action="Check the DHCP leases for a conflict.", rationale="one MAC at two addresses",
        extra={"old_ip": old, "new_ip": ip})


def arp_churn(arp: DataFrame, cfg: Config = Config()) -> DataFrame:
    """MAC changes on the whole network in the window reach the threshold, at each change."""
    changes = mac_changes(arp).select("event_id", "us")
    counted = sliding_count(changes, [], cfg.churn_window * SECOND, "changes")
    n = F.col("changes")
    return to_alerts(
        counted.where(n >= cfg.churn_changes), category="arp_anomaly", severity="high",
        affected="LAN", confidence=0.75, dedup_key="arp_churn:lan",
        title="Excessive ARP table churn detected",
        description=cat(n, f" MAC changes on the network in {cfg.churn_window} s."),
        action="Compare all MAC addresses with known good ones.",
        rationale=cat(n, " changes in the window"), extra={"changes": n})
