"""Thresholds, windows and lists that parameterise the operators. Times are seconds."""

from __future__ import annotations

from dataclasses import dataclass, replace

SECOND = 1_000_000  # event time is carried as microseconds


@dataclass(frozen=True)
class Adaptive:
    """Per-host back-off of rate thresholds."""
    enabled: bool = True
    trips_before_backoff: int = 5
    window: int = 3600
    step: float = 0.5
    max_multiplier: float = 4.0


@dataclass(frozen=True)
class Config:
    subnets: tuple[str, ...] = ("192.168.1.0/24",)
    gateway_ip: str = ""
    gateway_mac: str = ""
    interface: str = "eth0"
    allow_ips: tuple[str, ...] = ()
    allow_ports: tuple[int, ...] = ()
    allow_domains: tuple[str, ...] = ()
    trusted_ips: tuple[str, ...] = ()
    trusted_macs: tuple[str, ...] = ()
    adaptive: Adaptive = Adaptive()

    scan_window: int = 60
    scan_ports: int = 15
    scan_cooldown: int = 300
    sweep_window: int = 60
    sweep_hosts: int = 15
    sweep_cooldown: int = 300
    fanout_window: int = 60
    fanout_targets: int = 5
    fanout_cooldown: int = 300
    admin_pair_cooldown: int = 86400

    nxdomain_window: int = 60
    nxdomain_count: int = 20
    nxdomain_cooldown: int = 600
    dga_window: int = 60
    dga_domains: int = 50
    dga_cooldown: int = 600
    entropy_threshold: float = 3.8
    entropy_min_label: int = 10
    entropy_cooldown: int = 3600
    tunnel_label: int = 50
    tunnel_cooldown: int = 3600
    txt_label: int = 20
    txt_cooldown: int = 1800

    ssh_window: int = 120
    ssh_failures: int = 10
    new_login_cooldown: int = 3600
    sudo_cooldown: int = 3600
    account_cooldown: int = 86400

    flood_window: int = 10
    flood_replies: int = 20
    churn_window: int = 300
    churn_changes: int = 5

    beacon_intervals: int = 8
    beacon_cv: float = 0.15
    beacon_min_gap: float = 1.0
    beacon_min_mean: float = 5.0
    beacon_history: int | None = 200  # None: all events since the flow was last idle
    beacon_idle: int = 3600
    beacon_cooldown: int = 1800

    resolver_cooldown: int = 21600
    sanctioned_resolvers: tuple[str, ...] = ()
    intel_cooldown: int = 3600
    asn_cooldown: int = 3600
    suspicious_asns: tuple[int, ...] = ()
    asn_keywords: tuple[str, ...] = ()
    canary_ports: tuple[int, ...] = (23, 2323, 3389, 8081, 5555)
    canary_hosts: tuple[str, ...] = ()

    new_destination_cooldown: int = 86400
    new_listener_cooldown: int = 3600
    hours_min_known: int = 6
    ports_min_known: int = 8
    peers_min_known: int = 4
    protocols_min_known: int = 2
    byte_ranges_min_known: int = 3
    poll_interval: int = 60
    spike_factor: float = 3.0
    spike_z: float = 4.0
    spike_min_samples: int = 5
    spike_cooldown: int = 600
    traffic_factor: float = 5.0

    learning_start_us: int | None = None
    learning_hours: float = 24

    quiet_enabled: bool = False
    quiet_start: int = 23
    quiet_end: int = 7
    quiet_tz: str = "UTC"

    correlation_window: int = 300
    correlation_sensors: int = 2
    correlation_targets: int = 5
    correlation_cooldown: int = 600

    @property
    def learning_end_us(self) -> int | None:
        """End of the learning phase; None when learning is off."""
        if self.learning_start_us is None:
            return None
        return self.learning_start_us + int(self.learning_hours * 3600 * SECOND)

    def but(self, **changes) -> "Config":
        return replace(self, **changes)


# Named sensitivity profiles.
PROFILES = {
    "conservative": dict(scan_ports=30, spike_factor=5.0, beacon_cv=0.10, ssh_failures=20,
                         traffic_factor=8.0, fanout_targets=10),
    "balanced": {},
    "aggressive": dict(scan_ports=8, spike_factor=2.0, beacon_cv=0.20, ssh_failures=5,
                       traffic_factor=3.0, fanout_targets=3),
}


def with_profile(config: Config, profile: str) -> Config:
    """Thresholds of a named sensitivity profile; unknown names change nothing."""
    return config.but(**PROFILES.get(profile, {}))


@dataclass(frozen=True)
class ResponseConfig:
    """What to plan per alert. Planned actions are rows; nothing is executed."""
    enabled: bool = False
    dry_run: bool = True
    require_approval: bool = True
    trusted_categories: tuple[str, ...] = ()
    block_enabled: bool = True
    block_backend: str = "iptables"
    block_categories: tuple[str, ...] = ("threat_intel",)
    block_min_severity: str = "high"
    sinkhole_enabled: bool = True
    sinkhole_backend: str = "hosts"
    sinkhole_file: str = "sinkhole.hosts"
    sinkhole_categories: tuple[str, ...] = ("threat_intel", "dns_anomaly")
    sinkhole_min_severity: str = "high"
    repin_enabled: bool = True
    repin_backend: str = "arp"
    repin_min_severity: str = "high"
    custom_enabled: bool = True
    custom_command: tuple[str, ...] = ()
    custom_categories: tuple[str, ...] = ()
    custom_min_severity: str = "critical"
