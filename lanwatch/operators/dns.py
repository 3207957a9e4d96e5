"""DNS detections: generated names, tunnels, rates, suspicious zones, encrypted-DNS bypass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SECOND, Config
from ..functions.alerting import cat, evidence, explain, suffix, to_alerts
from ..functions.names import (domain_in_list, first_label, label_count, label_entropy, on_cdn, once,
                               strip_dots, suspicious_tld)
from ..functions.net import ip_in_subnets, resolver_provider
from .firsts import first_rows, not_in_baseline
from .lookup import not_allowed, with_hostname
from .scan import adaptive_note, after_learning
from .suppress import adaptive_cooldown, cooldown
from .windows import sliding_count, sliding_distinct


def analysed(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows the detectors look at, with `domain`: cleaned, 4 characters or more, not allowlisted."""
    rows = once(dns, domain=strip_dots(F.col("query_name")))
    return rows.where((F.length("domain") >= 4) & ~domain_in_list(F.col("domain"), cfg.allow_domains))


def nxdomain_rate(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Failed lookups per client in the window reach the threshold."""
    rows = analysed(dns, cfg).where("is_nxdomain").select("event_id", "us", "src_ip", "domain")
    counted = sliding_distinct(rows, ["src_ip"], "domain", cfg.nxdomain_window * SECOND,
                               "unique_domains", count_out="failures")
    fired = adaptive_cooldown(counted.where(F.col("failures") >= cfg.nxdomain_count), "src_ip",
                              "failures", cfg.nxdomain_count, cfg.nxdomain_cooldown, cfg.adaptive)
    n, src = F.col("failures"), F.col("src_ip")
    return to_alerts(
        fired, category="dns_anomaly", severity="high", affected=src, confidence=0.80,
        dedup_key=cat("nxdomain_rate:", src),
        title=cat("High NXDOMAIN rate: ", src, " (", n, " failures/min)"),
        description=cat(src, " got ", n, f" NXDOMAIN answers in {cfg.nxdomain_window} s for ",
                        F.col("unique_domains"), " names."),
        action=cat("Check ", src, " for malware that generates domain names."),
        rationale=cat(n, f" NXDOMAIN in {cfg.nxdomain_window} s"),
        extra={"nxdomain_count": n, "unique_domains": F.col("unique_domains")},
        explanation=explain(evidence(
            "nxdomain_per_minute", n, F.round("threshold", 1), ">=",
            adaptive_note(f"NXDOMAIN answers allowed in {cfg.nxdomain_window} s",
                          F.col("threshold"), cfg.nxdomain_count)),
            basis="0.80 once the failure threshold is reached"))


def dga_rate(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Distinct names per client in the window reach the threshold."""
    rows = analysed(dns, cfg).select("event_id", "us", "src_ip", "domain")
    counted = sliding_distinct(rows, ["src_ip"], "domain", cfg.dga_window * SECOND, "domains")
    fired = adaptive_cooldown(counted.where(F.col("domains") >= cfg.dga_domains), "src_ip",
                              "domains", cfg.dga_domains, cfg.dga_cooldown, cfg.adaptive)
    n, src = F.col("domains"), F.col("src_ip")
    return to_alerts(
        fired, category="dns_anomaly", severity="medium", affected=src, confidence=0.70,
        dedup_key=cat("dga_query_rate:", src),
        title=cat("High unique DNS query rate: ", src, " (", n, " unique/min)"),
        description=cat(src, " asked for ", n, f" different names in {cfg.dga_window} s."),
        action=cat("Check ", src, " for malware that generates domain names."),
        rationale=cat(n, f" distinct names in {cfg.dga_window} s"),
        extra={"unique_domains_per_minute": n},
        explanation=explain(evidence(
            "unique_domains_per_minute", n, F.round("threshold", 1), ">=",
            adaptive_note(f"distinct names allowed in {cfg.dga_window} s", F.col("threshold"),
                          cfg.dga_domains)), basis="0.70 once the name threshold is reached"))


def dns_entropy(dns: DataFrame, cfg: Config = Config(), baseline: DataFrame | None = None,
                known_mode: str = "prior") -> DataFrame:
    """Names whose first label looks random.

    While learning, alerts repeat after the cooldown. Afterwards only unknown domains alert:
    with `known_mode='prior'` a domain is known once an earlier event (or the baseline) had it;
    with 'recorded' the event itself already counts, so nothing fires after learning.
    """
    entropy = label_entropy(F.col("domain"))
    label = F.length(first_label(F.col("domain")))
    rows = (analysed(dns, cfg).select("event_id", "us", "src_ip", "domain")
            .where((label >= cfg.entropy_min_label) & ~on_cdn(F.col("domain"))))
    rows = once(rows, entropy=entropy).where(F.col("entropy") >= cfg.entropy_threshold)
    parts = []
    if cfg.learning_end_us is not None:
        parts.append(cooldown(rows.where(F.col("us") < cfg.learning_end_us), "domain",
                              cfg.entropy_cooldown).select(*rows.columns))
    if known_mode == "prior":
        fresh = not_in_baseline(first_rows(rows, ["domain"]), baseline, ["domain"])
        parts.append(after_learning(fresh, cfg).select(*rows.columns))
    fired = parts[0] if parts else rows.limit(0)
    for p in parts[1:]:
        fired = fired.unionByName(p)
    e, src, name = F.round("entropy", 3), F.col("src_ip"), F.col("domain")
    return to_alerts(
        fired, category="dns_anomaly", severity="medium", affected=src, confidence=0.65,
        dedup_key=cat("dga_entropy:", name), title=cat("High-entropy domain name: ", name),
        description=cat(src, " asked for ", name, ", whose first label looks random."),
        action=cat("Find out why ", src, " asks for this name."),
        rationale=cat("entropy ", F.format_number("entropy", 2), f" over {cfg.entropy_threshold}"),
        extra={"domain": name, "entropy": e, "threshold": F.lit(cfg.entropy_threshold)},
        explanation=explain(evidence("domain_entropy", e, F.lit(cfg.entropy_threshold), ">",
                                     "entropy of ordinary names"),
                            basis="0.65 for a random-looking name"))


def dns_tunnel_label(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """First label longer than a plausible name."""
    n = F.length(first_label(F.col("domain")))
    rows = (analysed(dns, cfg).select("event_id", "us", "src_ip", "domain")
            .withColumn("label_length", n).where(n > cfg.tunnel_label)
            .withColumn("head", F.substring("domain", 1, 50)))
    fired = cooldown(rows, "head", cfg.tunnel_cooldown)
    src, length = F.col("src_ip"), F.col("label_length")
    return to_alerts(
        fired, category="dns_anomaly", severity="high", affected=src, confidence=0.80,
        dedup_key=cat("dns_tunnel_label:", F.col("head")),
        title="Possible DNS tunneling: very long subdomain label",
        description=cat(src, " asked for a name whose first label has ", length, " characters."),
        action=cat("Inspect the DNS traffic of ", src, "."),
        rationale=cat("label of ", length, " characters"),
        extra={"domain": F.col("domain"), "label_length": length},
        explanation=explain(evidence("subdomain_label_length", length, F.lit(cfg.tunnel_label), ">",
                                     "longest plausible label"), basis="0.80 for an over-long label"))


def dns_tunnel_txt(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """TXT query with a long first label below a registered domain."""
    n = F.length(first_label(F.col("domain")))
    rows = (analysed(dns, cfg)
            .where((F.col("query_type") == "TXT") & (label_count(F.col("domain")) >= 2)
                   & (n > cfg.txt_label) & (n <= cfg.tunnel_label))
            .select("event_id", "us", "src_ip", "domain", "query_type")
            .withColumn("zone", F.substring_index("domain", ".", -2)).withColumn("label_length", n))
    fired = cooldown(rows, "zone", cfg.txt_cooldown)
    src, name = F.col("src_ip"), F.col("domain")
    return to_alerts(
        fired, category="dns_anomaly", severity="low", affected=src, confidence=0.55,
        dedup_key=cat("dns_txt_suspicious:", F.col("zone")),
        title=cat("Suspicious DNS TXT query: ", name),
        description=cat(src, " made a TXT query for ", name, "."),
        action="Watch the TXT queries of this host.", rationale="long first label on a TXT query",
        extra={"domain": name, "query_type": F.col("query_type")},
        explanation=explain(evidence("txt_query_subdomain_length", F.col("label_length"),
                                     F.lit(cfg.txt_label), ">", "label length of ordinary TXT queries"),
                            basis="0.55 for a long TXT label"))


def dns_tld(dns: DataFrame, cfg: Config = Config(), baseline: DataFrame | None = None) -> DataFrame:
    """First sight of a domain under a suspicious top-level domain, after learning."""
    rows = (analysed(dns, cfg).where(suspicious_tld(F.col("domain")))
            .select("event_id", "us", "src_ip", "domain"))
    fresh = after_learning(not_in_baseline(first_rows(rows, ["domain"]), baseline, ["domain"]), cfg)
    src, name = F.col("src_ip"), F.col("domain")
    return to_alerts(
        fresh, category="dns_anomaly", severity="info", affected=src, confidence=0.40,
        dedup_key=cat("suspicious_tld:", name), title=cat("Query to suspicious TLD: ", name),
        description=cat(src, " asked for ", name, " for the first time."),
        action="Watch this domain.", rationale="new name under an often abused zone",
        extra={"domain": name},
        explanation=explain(evidence("tld", F.substring_index(name, ".", -1), comparison="matches",
                                     baseline="often abused zones"),
                            basis="0.40 for the zone alone"))


def encrypted_dns(conn: DataFrame, cfg: Config = Config(), devices: DataFrame | None = None) -> DataFrame:
    """Local clients that use DNS over TLS or HTTPS with an outside resolver."""
    src, dst, port = F.col("src_ip"), F.col("dst_ip"), F.col("dst_port")
    provider = resolver_provider(dst)
    mode = F.when(port == 853, "DoT").when((port == 443) & provider.isNotNull(), "DoH")
    rows = (conn.where((F.col("protocol") == "tcp") & port.isin(443, 853)
                       & ip_in_subnets(src, cfg.subnets) & ~ip_in_subnets(dst, cfg.subnets)
                       & not_allowed(dst, cfg.allow_ips) & not_allowed(dst, cfg.sanctioned_resolvers))
            .select("event_id", "us", "src_ip", "dst_ip", "dst_port",
                    F.coalesce(provider, F.lit("an external resolver")).alias("provider"),
                    mode.alias("mode")).where(F.col("mode").isNotNull()))
    fired = with_hostname(cooldown(rows, ["src_ip", "dst_ip"], cfg.resolver_cooldown), devices, "src_ip")
    m, who = F.col("mode"), F.col("provider")
    return to_alerts(
        fired, category="dns_anomaly", severity="medium", affected=src, related=dst,
        confidence=F.when(m == "DoH", 0.6).otherwise(0.75), dedup_key=cat("doh:", src, ":", dst),
        title=cat("Encrypted DNS bypass (", m, "): ", src, suffix(F.col("hostname")), " → ", who),
        description=cat(src, " resolves names over ", m, " at ", dst, ":", port, "."),
        action=cat("Confirm that ", src, " may use ", who, ", or block it."),
        rationale=F.when(m == "DoH", "known resolver address").otherwise("dedicated port 853"),
        extra={"mode": m, "provider": who, "resolver_ip": dst, "port": port},
        explanation=explain(evidence(
            "encrypted_dns", cat(m, " to ", dst, ":", port, " (", who, ")"),
            comparison="not-in-baseline", baseline="sanctioned resolvers"),
            basis="0.6 for a known resolver, 0.75 for port 853"))
