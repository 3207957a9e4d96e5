"""Port scans, host sweeps, lateral fan-out, canary ports, new admin pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SECOND, Config
from ..functions import tables
from ..functions.alerting import cat, evidence, explain, to_alerts
from ..functions.net import admin_protocol, ip_in_subnets
from .firsts import first_rows, not_in_baseline
from .lookup import not_allowed
from .suppress import adaptive_cooldown
from .windows import sliding_distinct, window_members


def syn(df: DataFrame) -> DataFrame:
    """TCP rows whose flags contain S."""
    return df.where((F.col("protocol") == "tcp") & F.col("flags").contains("S"))


def after_learning(df: DataFrame, cfg: Config) -> DataFrame:
    """Rows after the learning phase; all rows when learning is off."""
    if cfg.learning_end_us is None:
        return df
    return df.where(F.col("us") >= cfg.learning_end_us)


def adaptive_note(text: str, threshold: Column, base: float) -> Column:
    return cat(text, F.when(threshold > base, cat(" (adaptive, base ", F.lit(base), ")")).otherwise(""))


def syn_sent_ports(sockets: DataFrame, cfg: Config) -> DataFrame:
    """Half-open outbound probes of socket snapshots, as connection rows for `port_scan`."""
    probes = sockets.where(
        (F.col("state") == "SYN_SENT") & ip_in_subnets(F.col("local_ip"), cfg.subnets)
        & ~ip_in_subnets(F.col("remote_ip"), cfg.subnets))
    return (probes.groupBy("us", "local_ip", "remote_ip", "remote_port")
            .agg(F.min("event_id").alias("event_id"))
            .select("event_id", "us", F.col("local_ip").alias("src_ip"),
                    F.col("remote_ip").alias("dst_ip"), F.col("remote_port").alias("dst_port"),
                    F.lit("tcp").alias("protocol"), F.lit("S").alias("flags")))


def _probes(conn: DataFrame, cfg: Config) -> DataFrame:
    return (syn(conn).where(not_allowed(F.col("src_ip"), cfg.allow_ips)
                            & not_allowed(F.col("dst_port"), cfg.allow_ports))
            .select("event_id", "us", "src_ip", "dst_ip", "dst_port"))


def port_scan(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Distinct destination ports per (source, target) in the window reach the threshold."""
    w = cfg.scan_window * SECOND
    rows = _probes(conn, cfg)
    counted = sliding_distinct(rows, ["src_ip", "dst_ip"], "dst_port", w, "ports")
    hits = counted.where(F.col("ports") >= cfg.scan_ports)
    fired = adaptive_cooldown(hits, "src_ip", "ports", cfg.scan_ports, cfg.scan_cooldown,
                              cfg.adaptive, pair="dst_ip")
    fired = window_members(fired, rows, ["src_ip", "dst_ip"], F.col("dst_port"), w, "all_ports")
    n, src, dst = F.col("ports"), F.col("src_ip"), F.col("dst_ip")
    return to_alerts(
        fired, category="port_scan",
        severity=F.when(n >= 100, "high").when(n >= 50, "medium").otherwise("low"),
        affected=dst, related=src, confidence=0.9,
        dedup_key=cat("port_scan:", src, ":", dst),
        title=cat("Port scan: ", src, " → ", dst, " (", n, " ports/min)"),
        description=cat(src, " tried ", n, " different ports of ", dst, f" in {cfg.scan_window} s."),
        action=cat("Find out whether ", src, " may scan; otherwise isolate or block it."),
        rationale=cat(n, f" distinct ports in {cfg.scan_window} s"),
        extra={"unique_ports_count": n, "sample_ports": F.slice("all_ports", 1, 10),
               "window_seconds": F.lit(cfg.scan_window)},
        explanation=explain(evidence(
            "unique_ports", n, F.round("threshold", 1), ">=",
            adaptive_note(f"distinct ports allowed in {cfg.scan_window} s", F.col("threshold"),
                          cfg.scan_ports)), basis="0.9 once the port threshold is reached"))


def host_sweep(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Distinct local targets per source in the window reach the threshold.

    Every probe of the source is a moment of test; only local targets count.
    """
    w = cfg.sweep_window * SECOND
    rows = _probes(conn, cfg).withColumn(
        "local_dst", F.when(ip_in_subnets(F.col("dst_ip"), cfg.subnets), F.col("dst_ip")))
    counted = sliding_distinct(rows.drop("dst_ip", "dst_port"), ["src_ip"], "local_dst", w, "hosts")
    fired = adaptive_cooldown(counted.where(F.col("hosts") >= cfg.sweep_hosts), "src_ip", "hosts",
                              cfg.sweep_hosts, cfg.sweep_cooldown, cfg.adaptive)
    n, src = F.col("hosts"), F.col("src_ip")
    return to_alerts(
        fired, category="port_scan", severity="medium", affected="LAN", related=src,
        confidence=0.8, dedup_key=cat("host_sweep:", src),
        title=cat("Host sweep: ", src, " contacted ", n, f" local hosts in {cfg.sweep_window}s"),
        description=cat(src, " contacted ", n, f" local hosts in {cfg.sweep_window} s."),
        action=cat("Check ", src, " for a worm or a reconnaissance tool."),
        rationale=cat(n, f" distinct local hosts in {cfg.sweep_window} s"),
        extra={"unique_hosts": n, "src_ip": src},
        explanation=explain(evidence(
            "unique_local_hosts", n, F.round("threshold", 1), ">=",
            adaptive_note(f"local hosts allowed in {cfg.sweep_window} s", F.col("threshold"),
                          cfg.sweep_hosts)), basis="0.8 once the host threshold is reached"))


def _internal(conn: DataFrame, cfg: Config) -> DataFrame:
    src, dst = F.col("src_ip"), F.col("dst_ip")
    return (conn.where(ip_in_subnets(src, cfg.subnets) & ip_in_subnets(dst, cfg.subnets)
                       & (src != dst) & not_allowed(src, cfg.allow_ips)
                       & not_allowed(dst, cfg.allow_ips))
            .select("event_id", "us", "src_ip", "dst_ip", "dst_port"))


def lateral_fanout(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Distinct local targets reached on administration ports in the window reach the threshold."""
    w = cfg.fanout_window * SECOND
    admin = F.col("dst_port").isin(list(tables.ADMIN_PORTS))
    rows = _internal(conn, cfg)
    counted = sliding_distinct(
        rows.withColumn("target", F.when(admin, F.col("dst_ip"))).drop("dst_ip", "dst_port"),
        ["src_ip"], "target", w, "targets")
    fired = adaptive_cooldown(counted.where(F.col("targets") >= cfg.fanout_targets), "src_ip",
                              "targets", cfg.fanout_targets, cfg.fanout_cooldown, cfg.adaptive)
    fired = window_members(fired, rows.where(admin), ["src_ip"],
                           F.struct("dst_ip", "dst_port"), w, "reached")
    n, src = F.col("targets"), F.col("src_ip")
    names = F.array_sort(F.array_distinct(F.transform(
        F.col("reached"), lambda r: admin_protocol(r["dst_port"]))))
    return to_alerts(
        fired, category="lateral_movement", severity="high", affected=src, confidence=0.80,
        dedup_key=cat("lateral_fanout:", src),
        title=cat("Possible lateral movement: ", src, " → ", n, " hosts via admin protocols"),
        description=cat(src, " reached ", n, " internal hosts over ", F.array_join(names, ", "),
                        f" in {cfg.fanout_window} s."),
        action=cat("Investigate ", src, " and consider isolating it."),
        rationale=cat(n, f" distinct admin targets in {cfg.fanout_window} s"),
        extra={"target_count": n, "protocols": names,
               "sample_targets": F.slice(F.array_distinct(F.col("reached.dst_ip")), 1, 5)},
        explanation=explain(evidence(
            "admin_targets_per_minute", n, F.round("threshold", 1), ">=",
            adaptive_note(f"admin targets allowed in {cfg.fanout_window} s", F.col("threshold"),
                          cfg.fanout_targets)), basis="0.80 once the target threshold is reached"))


def new_admin_pair(conn: DataFrame, cfg: Config = Config(), known_pairs: DataFrame | None = None,
                   destinations: DataFrame | None = None) -> DataFrame:
    """First administration connection between two local hosts, after learning.

    `known_pairs` (src_ip, dst_ip, dst_port) and tcp rows of `destinations` are not new.
    """
    keys = ["src_ip", "dst_ip", "dst_port"]
    rows = _internal(conn, cfg).where(F.col("dst_port").isin(list(tables.ADMIN_PORTS)))
    fresh = not_in_baseline(after_learning(first_rows(rows, keys), cfg), known_pairs, keys)
    if destinations is not None:
        fresh = not_in_baseline(fresh, destinations.where("protocol = 'tcp'"), keys)
    src, dst, port = F.col("src_ip"), F.col("dst_ip"), F.col("dst_port")
    name = admin_protocol(port)
    return to_alerts(
        fresh, category="lateral_movement", severity="medium", affected=dst, related=src,
        confidence=0.60, dedup_key=cat("new_admin:", src, ":", dst, ":", port),
        title=cat("New ", name, " connection: ", src, " → ", dst),
        description=cat(src, " used ", name, " (port ", port, ") to ", dst, " for the first time."),
        action=cat("Verify that ", src, " may administer ", dst, "."),
        rationale="first connection of this source, target and admin port",
        extra={"protocol": name, "port": port},
        explanation=explain(evidence(
            "admin_connection", cat(src, " → ", dst, ":", port, " (", name, ")"),
            comparison="first-seen", baseline="known internal admin pairs"),
            basis="0.60 for a first admin connection"))


def canary_hits(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Connections to a canary port of a canary host (any local host when none is named)."""
    src, dst, port = F.col("src_ip"), F.col("dst_ip"), F.col("dst_port")
    where = dst.isin(list(cfg.canary_hosts)) if cfg.canary_hosts else ip_in_subnets(dst, cfg.subnets)
    return to_alerts(
        conn.where(port.isin(list(cfg.canary_ports)) & where), category="honeypot",
        severity="high", affected=src, confidence=0.95,
        dedup_key=cat("honeypot:", src, ":", port),
        title=cat("Honeypot triggered: ", src, " probed canary port ", port),
        description=cat(src, " connected to canary port ", port, ", which serves nobody."),
        action=cat("Identify the device and process at ", src, "."),
        rationale="direct connection to a canary port",
        extra={"canary_port": port, "source": src})
