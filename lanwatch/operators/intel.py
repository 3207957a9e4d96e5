"""Matches against indicators, and reputation of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..functions.alerting import cat, evidence, explain, suffix, to_alerts
from ..functions.net import ip_in_subnets, is_private_ip
from .lineage import cut
from .lookup import asn_lookup, match_domain, match_ip, not_allowed, with_hostname
from .suppress import cooldown

_COLUMNS = ["event_id", "us", "host", "related", "what", "step", "hit"]


def connection_hits(conn: DataFrame, indicators: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Connections to a listed outside address, before the cooldown."""
    dst = F.col("dst_ip")
    rows = conn.where((dst != "") & ~ip_in_subnets(dst, cfg.subnets) & not_allowed(dst, cfg.allow_ips))
    return (match_ip(rows, "dst_ip", indicators, how="inner")
            .select("event_id", "us", F.col("src_ip").alias("host"), dst.alias("related"),
                    cat("connection to ", dst, ":", F.col("dst_port")).alias("what"),
                    F.lit(0).alias("step"), "hit"))


def dns_hits(dns: DataFrame, indicators: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Lookups of a listed name, and answers that point to a listed address."""
    name, answer = F.col("query_name"), F.col("response_ip")
    rows = dns.select("event_id", "us", "src_ip", "query_name", "response_ip")
    asked = (match_domain(rows.where((name != "") & not_allowed(name, cfg.allow_ips)),
                          "query_name", indicators, how="inner")
             .select("event_id", "us", F.col("src_ip").alias("host"), name.alias("related"),
                     cat("DNS lookup of ", name).alias("what"), F.lit(0).alias("step"), "hit"))
    answered = (match_ip(rows.where((answer != "") & ~ip_in_subnets(answer, cfg.subnets)),
                         "response_ip", indicators, how="inner")
                .select("event_id", "us", F.col("src_ip").alias("host"), answer.alias("related"),
                        cat(name, " resolving to ", answer).alias("what"), F.lit(1).alias("step"), "hit"))
    return asked.unionByName(answered)


def intel_hits(conn: DataFrame | None, dns: DataFrame | None, indicators: DataFrame,
               cfg: Config = Config()) -> DataFrame:
    """Alerts for indicator hits of both streams under one cooldown per indicator.

    The hits are written: the events are read once for the addresses that have a hit, and once for the hits. The
    cooldown sees only what it decides by; the rest of a row is fetched for the rows it keeps, of repeated rows the
    least in the order of all columns.
    """
    parts = []
    if conn is not None:
        parts.append(connection_hits(conn, indicators, cfg))
    if dns is not None:
        parts.append(dns_hits(dns, indicators, cfg))
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    place = ["indicator", "us", "turn"]
    hits = cut(hits.select(F.col("hit.value").alias("indicator"), "us", F.struct("event_id", "step").alias("turn"),
                           F.struct("host", "related", "what", "hit").alias("row")))
    kept = cut(cooldown(hits.select(*place), "indicator", cfg.intel_cooldown, tie="turn"))
    return hit_alerts(hits.join(kept, place).groupBy(*place).agg(F.min("row").alias("row")).select("us", "row.*"))


def hit_alerts(hits: DataFrame) -> DataFrame:
    hit, related, host = F.col("hit"), F.col("related"), F.col("host")
    return to_alerts(
        hits, category="threat_intel", severity="high", affected=host, related=related,
        confidence=0.95, dedup_key=cat("threatintel:", hit["value"]),
        title=cat("Known-bad ", hit["kind"], ": ", related),
        description=cat(host, " had a ", F.col("what"), ", listed by ", hit["source"], " as ",
                        hit["category"], "."),
        action=cat("Treat ", host, " as compromised and block ", related, "."),
        rationale=cat("exact match on ", hit["source"]),
        extra={"indicator": hit["value"], "indicator_kind": hit["kind"], "source": hit["source"],
               "category": hit["category"]},
        explanation=explain(evidence(cat(hit["kind"], "_indicator"), hit["value"],
                                     comparison="exact-match",
                                     baseline=cat(hit["source"], " list (", hit["category"], ")")),
                            basis="0.95 for an exact match"))


def asn_hits(conn: DataFrame, prefixes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Connections to listed AS numbers or to operators whose name has a listed keyword, before the cooldown."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    rows = asn_lookup(conn.where(ip_in_subnets(src, cfg.subnets) & ~is_private_ip(dst) & (dst != "")
                                 & not_allowed(dst, cfg.allow_ips))
                      .select("event_id", "us", "src_ip", "dst_ip"), "dst_ip", prefixes)
    asn, org = F.col("asn"), F.col("org")
    reason = F.when(asn.isin(list(cfg.suspicious_asns)) if cfg.suspicious_asns else F.lit(False),
                    cat("AS", asn, " is listed as suspicious"))
    for word in ["bulletproof", *cfg.asn_keywords]:
        if word:
            reason = reason.when(F.instr(F.lower(org), word.lower()) > 0,
                                 cat("operator '", org, f"' matches '{word.lower()}'"))
    return rows.where(asn != 0).withColumn("reason", reason).where(F.col("reason").isNotNull())


def asn_reputation(conn: DataFrame, prefixes: DataFrame, cfg: Config = Config(),
                   devices: DataFrame | None = None) -> DataFrame:
    """Alerts for `asn_hits`, one per source and AS number and cooldown."""
    hits = asn_hits(conn, prefixes, cfg)
    return asn_alerts(with_hostname(cooldown(hits, ["src_ip", "asn"], cfg.asn_cooldown), devices, "src_ip"))


def asn_alerts(fired: DataFrame) -> DataFrame:
    src, dst, asn, org = (F.col(c) for c in ("src_ip", "dst_ip", "asn", "org"))
    name = F.when(org != "", org).otherwise(cat("AS", asn))
    return to_alerts(
        fired, category="connection_anomaly", severity="medium", affected=src, related=dst,
        confidence=0.55, dedup_key=cat("asn:", src, ":", asn),
        title=cat("Connection to flagged network: ", src, suffix(F.col("hostname")), " → ", name,
                  " (AS", asn, ")"),
        description=cat(src, " connected to ", dst, " of ", name, ": ", F.col("reason"), "."),
        action=cat("Check what ", src, " wants from ", dst, "."), rationale=F.col("reason"),
        extra={"asn": asn, "org": org, "dst_ip": dst, "reason": F.col("reason")},
        explanation=explain(evidence("destination_asn", cat("AS", asn, " (", name, ")"),
                                     comparison="matches", baseline="listed AS numbers and keywords"),
                            basis="0.55 for a flagged network"))
