"""Detectors by name. Users add their own: a function from event tables to alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .config import Config
from .operators import arp, auth, beacon, dns, intel, profile, scan, volume

Detector = Callable[[DataFrame, Config], DataFrame]

# name -> (kind of event table, detector)
DETECTORS: dict[str, tuple[str, Detector]] = {
    "port_scan": ("connections", scan.port_scan),
    "host_sweep": ("connections", scan.host_sweep),
    "lateral_fanout": ("connections", scan.lateral_fanout),
    "new_admin_pair": ("connections", scan.new_admin_pair),
    "canary_hits": ("connections", scan.canary_hits),
    "beacon": ("connections", beacon.beacon),
    "encrypted_dns": ("connections", dns.encrypted_dns),
    "new_destination": ("connections", profile.new_destination),
    "active_hours": ("connections", profile.active_hours),
    "off_profile": ("connections", profile.off_profile),
    "connection_spike": ("connections", volume.connection_spike),
    "nxdomain_rate": ("dns", dns.nxdomain_rate),
    "dga_rate": ("dns", dns.dga_rate),
    "dns_entropy": ("dns", dns.dns_entropy),
    "dns_tunnel_label": ("dns", dns.dns_tunnel_label),
    "dns_tunnel_txt": ("dns", dns.dns_tunnel_txt),
    "dns_tld": ("dns", dns.dns_tld),
    "arp_conflict": ("arp", arp.arp_conflict),
    "gateway_mac_change": ("arp", arp.gateway_mac_change),
    "arp_flood": ("arp", arp.arp_flood),
    "arp_churn": ("arp", arp.arp_churn),
    "new_device": ("arp", arp.new_device),
    "mac_change": ("arp", arp.mac_change),
    "ip_change": ("arp", arp.ip_change),
    "ssh_brute_force": ("auth_events", auth.ssh_brute_force),
    "new_ssh_source": ("auth_events", auth.new_ssh_source),
    "sudo_sensitive": ("auth_events", auth.sudo_sensitive),
    "sudo_failure": ("auth_events", auth.sudo_failure),
    "new_account": ("auth_events", auth.new_account),
}


# name -> (event tables of which at least one is needed, further tables needed, detector of a dict of tables)
JOINED: dict[str, tuple[tuple[str, ...], tuple[str, ...], Callable[[dict[str, DataFrame], Config], DataFrame]]] = {
    "intel_hits": (("connections", "dns"), ("indicators",),
                   lambda t, cfg: intel.intel_hits(t.get("connections"), t.get("dns"), t["indicators"], cfg)),
    "asn_reputation": (("connections",), ("prefixes",),
                       lambda t, cfg: intel.asn_reputation(t["connections"], t["prefixes"], cfg, t.get("devices"))),
    "new_country": (("connections",), ("prefixes",),
                    lambda t, cfg: profile.new_country(t["connections"], t["prefixes"], cfg=cfg, devices=t.get("devices"))),
    "half_open_scan": (("sockets",), (), lambda t, cfg: scan.port_scan(scan.syn_sent_ports(t["sockets"], cfg), cfg)),
    "beacon_from_sockets": (("sockets",), (), lambda t, cfg: beacon.beacon_from_sockets(t["sockets"], cfg)),
    "new_listener": (("sockets",), (), lambda t, cfg: profile.new_listener(t["sockets"], cfg)),
}


def register(name: str, kind: str, detector: Detector) -> None:
    DETECTORS[name] = (kind, detector)


def names_for(inputs: dict[str, DataFrame]) -> list[str]:
    """Detectors whose tables are all given."""
    single = [n for n, (kind, _) in DETECTORS.items() if kind in inputs]
    return single + [n for n, (some, every, _) in JOINED.items() if any(k in inputs for k in some) and all(k in inputs for k in every)]


def detect(inputs: dict[str, DataFrame], cfg: Config = Config(),
           names: list[str] | None = None) -> DataFrame:
    """Raw alerts of the named detectors (all by default) whose tables are given; `names_for` tells which these are."""
    from .plans.alerts import union_alerts
    chosen = [n for n in names_for(inputs) if names is None or n in names]
    return union_alerts(*[DETECTORS[n][1](inputs[DETECTORS[n][0]], cfg) if n in DETECTORS else JOINED[n][2](inputs, cfg) for n in chosen])
