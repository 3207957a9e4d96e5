"""Building blocks of alert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import tables
from .net import lookup

ALERT_COLUMNS = ["alert_id", "us", "severity", "category", "affected_host", "affected_mac",
                 "related_host", "title", "description", "recommended_action", "confidence",
                 "confidence_rationale", "dedup_key", "status", "extra", "sensor"]
ALERT_SCHEMA = ("alert_id string, us bigint, severity string, category string, affected_host string, "
                "affected_mac string, related_host string, title string, description string, "
                "recommended_action string, confidence double, confidence_rationale string, "
                "dedup_key string, status string, extra string, sensor string")


def severity_rank(c: Column) -> Column:
    """0 (info) to 4 (critical); null for unknown text."""
    return lookup(c, {s: i for i, s in enumerate(tables.SEVERITIES)})


def at_least(c: Column, floor: str) -> Column:
    """Severity at or above a floor; an unknown floor lets nothing through."""
    if floor not in tables.SEVERITIES:
        return F.lit(False)
    return severity_rank(c) >= tables.SEVERITIES.index(floor)


def severity_name(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(tables.SEVERITIES)))


def default_dedup_key(key: Column, category: Column, host: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(key, F.lit("")), F.concat_ws(":", category, host, title))


def cat(*parts) -> Column:
    """Concatenate texts and columns; numbers are cast."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def suffix(c: Column) -> Column:
    """` (name)` when the name is present, else empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", cat(" (", c, ")")).otherwise("")


def evidence(metric, observed: Column, threshold: Column | None = None,
             comparison: str = "", baseline="") -> Column:
    """One measured signal and what it was compared with; empty parts are left out of the JSON."""
    def text(v):
        return F.nullif(v if isinstance(v, Column) else F.lit(v), F.lit(""))
    return F.struct(
        text(metric).alias("metric"), observed.cast("string").alias("observed"),
        (threshold if threshold is not None else F.lit(None)).cast("double").alias("threshold"),
        text(comparison).alias("comparison"), text(baseline).alias("baseline"))


def explain(*items: Column, basis: str = "") -> Column:
    """Explanation payload of an alert: evidence list and how the confidence was set."""
    return F.struct(F.array(*items).alias("evidence"),
                    F.nullif(F.lit(basis), F.lit("")).alias("confidence_basis"))


def source_destination(category: Column, affected: Column, mac: Column, related: Column) -> Column:
    """(ip, mac, destination) as a SIEM sees them: the actor is the source.

    Scans and lateral movement name the actor in `related_host`.
    """
    swap = category.isin("port_scan", "lateral_movement") & (F.coalesce(related, F.lit("")) != "")
    return F.struct(F.when(swap, related).otherwise(affected).alias("ip"),
                    F.when(swap, F.lit("")).otherwise(mac).alias("mac"),
                    F.when(swap, affected).otherwise(related).alias("dest"))


def to_alerts(df: DataFrame, *, severity, category: str, affected, title, confidence, dedup_key,
              related="", mac="", description="", action="", rationale="",
              extra: dict | None = None, explanation: Column | None = None,
              sensor: Column | None = None) -> DataFrame:
    """Project detector rows (which carry `us`) onto the alert schema."""
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    fields = [c.alias(name) for name, c in (extra or {}).items()]
    if explanation is not None:
        fields.append(explanation.alias("explanation"))
    key = col(dedup_key)
    return df.select(
        F.sha2(F.concat_ws("|", key, F.col("us").cast("string")), 256).alias("alert_id"),
        F.col("us").cast("bigint").alias("us"),
        col(severity).alias("severity"), F.lit(category).alias("category"),
        F.coalesce(col(affected), F.lit("")).alias("affected_host"),
        F.coalesce(col(mac), F.lit("")).alias("affected_mac"),
        F.coalesce(col(related), F.lit("")).alias("related_host"),
        col(title).alias("title"), col(description).alias("description"),
        col(action).alias("recommended_action"),
        col(confidence).cast("double").alias("confidence"),
        col(rationale).alias("confidence_rationale"), key.alias("dedup_key"),
        F.lit("new").alias("status"),
        (F.to_json(F.struct(*fields)) if fields else F.lit("{}")).alias("extra"),
        (sensor if sensor is not None else F.lit(None)).cast("string").alias("sensor"))
