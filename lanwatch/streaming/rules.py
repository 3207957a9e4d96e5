"""Detections and rollups that run natively on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..operators.auth import new_account, sudo_failure, sudo_sensitive
from ..operators.dns import dns_tunnel_label, dns_tunnel_txt, encrypted_dns
from ..operators.intel import asn_alerts, asn_hits, connection_hits, dns_hits, hit_alerts
from ..operators.lookup import with_hostname
from ..operators.scan import canary_hits

_NO_COOLDOWN = dict(tunnel_cooldown=0, txt_cooldown=0, resolver_cooldown=0, sudo_cooldown=0,
                    account_cooldown=0)


def dns_rules(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per-row DNS rules; repeats are left to the alert dedup downstream."""
    cfg = cfg.but(**_NO_COOLDOWN)
    return dns_tunnel_label(dns, cfg).unionByName(dns_tunnel_txt(dns, cfg))


def connection_rules(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    cfg = cfg.but(**_NO_COOLDOWN)
    return encrypted_dns(conn, cfg).unionByName(canary_hits(conn, cfg))


def auth_rules(auth: DataFrame, cfg: Config = Config()) -> DataFrame:
    cfg = cfg.but(**_NO_COOLDOWN)
    return sudo_sensitive(auth, cfg).unionByName(sudo_failure(auth, cfg)).unionByName(
        new_account(auth, cfg))


def intel_rules(indicators: DataFrame, conn: DataFrame | None = None, dns: DataFrame | None = None,
                cfg: Config = Config()) -> DataFrame:
    """Indicator hits of connections, lookups and answers: the rows of `intel_hits` before its cooldown.

    Every row is joined to at most one row of each static side, so nothing is kept between batches.
    """
    parts = [hit_alerts(hits) for hits in ([connection_hits(conn, indicators, cfg)] if conn is not None else [])
             + ([dns_hits(dns, indicators, cfg)] if dns is not None else [])]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def asn_rules(conn: DataFrame, prefixes: DataFrame, cfg: Config = Config(), devices: DataFrame | None = None) -> DataFrame:
    """Connections to flagged networks: the rows of `asn_reputation` before its cooldown."""
    return asn_alerts(with_hostname(asn_hits(conn, prefixes, cfg), devices, "src_ip"))


# The functions below keep state; their input carries a watermark on `ts`, as `stream_events` sets it.

def without_duplicates(events: DataFrame, keys: list[str]) -> DataFrame:
    """Drop repeated deliveries of an event inside the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def connection_counts(conn: DataFrame, every: str = "60 seconds") -> DataFrame:
    """Connections per source and tumbling interval."""
    return (conn.groupBy(F.window("ts", every), "src_ip")
            .agg(F.count("*").alias("n"))
            .select("src_ip", F.unix_micros("window.start").alias("us"), "n"))


def flow_sessions(conn: DataFrame, idle: str = "3600 seconds") -> DataFrame:
    """Activity sessions per flow: a flow idle for longer starts anew."""
    return (conn.groupBy(F.session_window("ts", idle), "src_ip", "dst_ip", "dst_port")
            .agg(F.count("*").alias("events"), F.min("us").alias("first"), F.max("us").alias("last"))
            .drop("session_window"))
