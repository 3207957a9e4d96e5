"""Detections on authentication events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SECOND, Config
from ..functions import tables
from ..functions.alerting import cat, evidence, explain, suffix, to_alerts
from ..functions.moments import from_us
from .firsts import first_rows, not_in_baseline
from .lookup import geo_lookup, not_allowed
from .suppress import cooldown
from .windows import sliding_count


def ssh_brute_force(auth: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Failed SSH logins per source in the window reach the threshold. No allowlist applies."""
    rows = auth.where("event_kind = 'ssh_failure'").select("event_id", "us", "src_ip", "usr")
    counted = sliding_count(rows, ["src_ip"], cfg.ssh_window * SECOND, "failures")
    fired = cooldown(counted.where(F.col("failures") >= cfg.ssh_failures), "src_ip", cfg.ssh_window)
    n, src = F.col("failures"), F.col("src_ip")
    return to_alerts(
        fired, category="auth_anomaly", severity="high", affected="localhost", related=src,
        confidence=0.95, dedup_key=cat("ssh_brute:", src),
        title=cat("SSH brute force: ", src, " (", n, f" failures in {cfg.ssh_window}s)"),
        description=cat(src, " failed ", n, f" SSH logins in {cfg.ssh_window} s; last user ",
                        F.col("usr"), "."),
        action=cat("Block ", src, " and prefer key-only logins."),
        rationale=cat(n, f" failures in {cfg.ssh_window} s"),
        extra={"failure_count": n, "window_seconds": F.lit(cfg.ssh_window),
               "last_user": F.col("usr")},
        explanation=explain(evidence("ssh_failures", n, F.lit(cfg.ssh_failures), ">=",
                                     f"failures allowed in {cfg.ssh_window} s"),
                            basis="0.95 once the failure threshold is reached"))


def new_ssh_source(auth: DataFrame, cfg: Config = Config(), baseline: DataFrame | None = None,
                   prefixes: DataFrame | None = None) -> DataFrame:
    """First accepted login of a source address. `baseline` holds known `src_ip`."""
    logins = auth.where("event_kind = 'ssh_success'").select("event_id", "us", "src_ip", "usr")
    fresh = not_in_baseline(first_rows(logins, ["src_ip"]), baseline, ["src_ip"])
    fresh = fresh.where(not_allowed(F.col("src_ip"), cfg.allow_ips))
    fresh = geo_lookup(fresh, "src_ip", prefixes) if prefixes is not None else (
        fresh.withColumn("country", F.lit("")))
    src, usr, where = F.col("src_ip"), F.col("usr"), suffix(F.col("country"))
    return to_alerts(
        fresh, category="auth_anomaly", severity="medium", affected="localhost", related=src,
        confidence=0.80, dedup_key=cat("new_ssh_login:", src, ":", usr),
        title=cat("New SSH login: ", usr, " from ", src, where),
        description=cat(usr, " logged in over SSH from ", src, where, " for the first time."),
        action=cat("Verify the login from ", src, "."), rationale="first accepted login of this source",
        extra={"user": usr, "src_ip": src, "country": F.col("country")},
        explanation=explain(evidence("ssh_login_source", cat(usr, "@", src, where),
                                     comparison="first-seen", baseline="sources with earlier logins"),
                            basis="0.80 for a first login of a source"))


def sudo_sensitive(auth: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Sudo commands that open shells or change accounts."""
    sensitive = F.lit(False)
    for part in tables.SENSITIVE_COMMANDS:
        sensitive = sensitive | F.col("command").contains(part)
    rows = (auth.where((F.col("event_kind") == "sudo") & sensitive)
            .select("event_id", "us", "command", F.substring("command", 1, 50).alias("head")))
    cmd = F.col("command")
    return to_alerts(
        cooldown(rows, "head", cfg.sudo_cooldown), category="auth_anomaly", severity="low",
        affected="localhost", confidence=0.70, dedup_key=cat("sudo_sensitive:", F.col("head")),
        title=cat("Sensitive sudo command executed: ", F.substring(cmd, 1, 60)),
        description=cat("sudo ran: ", cmd), action="Verify that this use of sudo was authorised.",
        rationale="sensitive command in the sudo log", extra={"command": cmd},
        explanation=explain(evidence("sudo_command", F.substring(cmd, 1, 120), comparison="matches",
                                     baseline="sensitive commands"), basis="0.70 for a sensitive command"))


def sudo_failure(auth: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Failed sudo authentications; the dedup key groups them by hour."""
    hour = F.date_format(from_us(F.col("us")), "yyyyMMddHH")
    return to_alerts(
        auth.where("event_kind = 'sudo_failure'"), category="auth_anomaly", severity="low",
        affected="localhost", confidence=0.60, dedup_key=cat("sudo_failure:", hour),
        title="Failed sudo attempt", description="A sudo authentication failed.",
        action="Find out who tried to use sudo.", rationale="seen in the log",
        explanation=explain(evidence("sudo_auth", F.lit("failure"), comparison="observed",
                                     baseline="sudo authentication"), basis="0.60 for a logged failure"))


def new_account(auth: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Accounts created on the system."""
    rows = auth.where("event_kind = 'new_user'")
    rows = rows.select("event_id", "us", "usr", *(["line"] if "line" in auth.columns else []))
    usr = F.col("usr")
    extra = {"user": usr} | ({"log_line": F.col("line")} if "line" in auth.columns else {})
    return to_alerts(
        cooldown(rows, "usr", cfg.account_cooldown), category="auth_anomaly", severity="medium",
        affected="localhost", confidence=1.0, dedup_key=cat("new_user:", usr),
        title=cat("New user account created: ", usr),
        description=cat("Account ", usr, " was created."),
        action="Verify that this account was created on purpose.", rationale="seen in the log",
        extra=extra,
        explanation=explain(evidence("new_user_account", usr, comparison="created",
                                     baseline="useradd log lines"), basis="1.0 for a logged event"))
