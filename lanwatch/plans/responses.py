"""Planned responses as rows: what could be done about an alert, and whether it may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Config, ResponseConfig
from ..functions.alerting import at_least, cat
from ..functions.net import is_private_ip, is_valid_ip
from ..operators.lookup import not_allowed


def _plan(rows: DataFrame, responder: str, target, description, commands) -> DataFrame:
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(responder), "alert_id"), 256).alias("action_id"),
        "alert_id", "us", "category", F.lit(responder).alias("responder"), target.alias("target"),
        description.alias("description"), commands.cast("array<string>").alias("commands"))


def plan_blocks(alerts: DataFrame, rc: ResponseConfig, cfg: Config = Config()) -> DataFrame:
    """Firewall block of the first public, not allowlisted address of (related, affected)."""
    candidates = F.filter(F.array("related_host", "affected_host"), lambda ip:
                          is_valid_ip(ip) & ~is_private_ip(ip) & not_allowed(ip, cfg.allow_ips))
    rows = (alerts.where(F.lit(rc.block_enabled) & F.col("category").isin(list(rc.block_categories))
                         & at_least(F.col("severity"), rc.block_min_severity))
            .withColumn("_ip", F.try_element_at(candidates, F.lit(1))).where(F.col("_ip").isNotNull()))
    ip = F.col("_ip")
    if rc.block_backend == "nftables":
        commands = F.array(cat("nft add rule inet filter output ip daddr ", ip, " drop"),
                           cat("nft add rule inet filter input ip saddr ", ip, " drop"))
    else:
        commands = F.array(cat("iptables -I OUTPUT -d ", ip, " -j DROP"),
                           cat("iptables -I INPUT -s ", ip, " -j DROP"))
    return _plan(rows, "firewall", ip, cat("Block ", ip, f" in both directions ({rc.block_backend})"),
                 commands)


def plan_sinkholes(alerts: DataFrame, rc: ResponseConfig, cfg: Config = Config()) -> DataFrame:
    """Sinkhole of a related host that is a domain and not allowlisted."""
    name = F.rtrim(F.lower(F.trim("related_host")), F.lit("."))
    allowed = [d.lower() for d in cfg.allow_domains]
    rows = (alerts.where(F.lit(rc.sinkhole_enabled) & F.col("category").isin(list(rc.sinkhole_categories))
                         & at_least(F.col("severity"), rc.sinkhole_min_severity))
            .withColumn("_name", name)
            .where((F.col("_name") != "") & (F.instr("_name", ".") > 0)
                   & ~is_valid_ip(F.col("_name")) & not_allowed(F.col("_name"), allowed)))
    d = F.col("_name")
    commands = {"pihole": F.array(cat("pihole -b ", d)),
                "unbound": F.array(cat("unbound-control local_zone ", d, " always_nxdomain"))}
    where = (cat("Sinkhole ", d, f" in {rc.sinkhole_file}") if rc.sinkhole_backend == "hosts"
             else cat("Sinkhole ", d, f" via {rc.sinkhole_backend}"))
    return _plan(rows, "dns_sinkhole", d, where, commands.get(rc.sinkhole_backend, F.array()))


def plan_repin(alerts: DataFrame, rc: ResponseConfig, cfg: Config = Config()) -> DataFrame:
    """Re-pin the configured gateway MAC after an ARP alert about the gateway."""
    ready = rc.repin_enabled and bool(cfg.gateway_ip and cfg.gateway_mac)
    rows = alerts.where(F.lit(ready) & (F.col("category") == "arp_anomaly")
                        & (F.get_json_object("extra", "$.is_gateway") == "true")
                        & at_least(F.col("severity"), rc.repin_min_severity))
    ip, mac = cfg.gateway_ip, cfg.gateway_mac
    command = (f"ip neigh replace {ip} lladdr {mac} dev {cfg.interface}" if rc.repin_backend == "ip"
               else f"arp -s {ip} {mac}")
    return _plan(rows, "arp_restore", F.lit(ip), F.lit(f"Pin gateway MAC {mac} for {ip}"),
                 F.array(F.lit(command)))


def plan_custom(alerts: DataFrame, rc: ResponseConfig) -> DataFrame:
    """The configured command with its placeholders filled in, as text only."""
    ready = rc.custom_enabled and bool(rc.custom_command and rc.custom_categories)
    target = F.coalesce(F.nullif("affected_host", F.lit("")), F.nullif("related_host", F.lit("")))
    rows = alerts.where(F.lit(ready) & F.col("category").isin(list(rc.custom_categories))
                        & at_least(F.col("severity"), rc.custom_min_severity) & target.isNotNull())
    text = F.lit(" ".join(rc.custom_command))
    for mark, column in (("{ip}", "affected_host"), ("{mac}", "affected_mac"),
                         ("{related}", "related_host"), ("{category}", "category"),
                         ("{severity}", "severity")):
        text = F.replace(text, F.lit(mark), F.col(column))
    return _plan(rows, "killswitch", target, cat("Run ", text), F.array(text))


def plan_status(plan: DataFrame, rc: ResponseConfig) -> DataFrame:
    """Gate the plan: nothing when off, planned in a dry run, else pending or ready."""
    trusted = (F.col("category").isin(list(rc.trusted_categories)) if rc.trusted_categories
               else F.lit(False))
    pending = F.lit(rc.require_approval) & ~trusted
    status = F.lit("planned") if rc.dry_run else F.when(pending, "pending").otherwise("ready")
    return (plan.where(F.lit(rc.enabled)).withColumn("status", status)
            .withColumn("dry_run", F.lit(rc.dry_run)))


def response_plan(alerts: DataFrame, rc: ResponseConfig, cfg: Config = Config()) -> DataFrame:
    """All planned responses with their gate status."""
    plan = (plan_blocks(alerts, rc, cfg).unionByName(plan_sinkholes(alerts, rc, cfg))
            .unionByName(plan_repin(alerts, rc, cfg)).unionByName(plan_custom(alerts, rc)))
    return plan_status(plan, rc)
