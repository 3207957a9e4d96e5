"""First-seen behaviour of hosts: destinations, listeners, countries, hours, profile values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config
from ..functions import tables
from ..functions.alerting import cat, evidence, explain, suffix, to_alerts
from ..functions.moments import hour_of_day
from ..functions.net import byte_bucket, ip_in_subnets, is_private_ip
from .firsts import first_rows, first_seen, not_in_baseline
from .lookup import geo_lookup, not_allowed, with_hostname
from .scan import after_learning
from .suppress import cooldown


def new_destination(conn: DataFrame, cfg: Config = Config(), baseline: DataFrame | None = None,
                    prefixes: DataFrame | None = None) -> DataFrame:
    """First connection of a host to an outside (address, port, protocol), after learning."""
    keys = ["src_ip", "dst_ip", "dst_port", "protocol"]
    src, dst, port = F.col("src_ip"), F.col("dst_ip"), F.col("dst_port")
    rows = conn.where(F.col("state").isin("ESTABLISHED", "SYN_SENT")) if "state" in conn.columns else conn
    process = "process_name" in conn.columns
    rows = rows.where(~is_private_ip(dst)).select(
        "event_id", "us", *keys, F.col("process_name") if process else F.lit("").alias("process_name"))
    fresh = not_in_baseline(after_learning(first_rows(rows, keys), cfg), baseline, keys)
    fired = cooldown(fresh.where(not_allowed(dst, cfg.allow_ips)), keys[:3], cfg.new_destination_cooldown)
    fired = geo_lookup(fired, "dst_ip", prefixes) if prefixes is not None else (
        fired.withColumn("country", F.lit("")))
    odd = port.isin(tables.SUSPICIOUS_PORTS)
    where = suffix(F.col("country"))
    return to_alerts(
        fired, category="connection_anomaly", affected=src, related=dst, confidence=0.6,
        severity=F.when(odd & ~port.isin(tables.COMMON_OUTBOUND_PORTS), "medium").otherwise("info"),
        dedup_key=cat("new_dest:", src, ":", dst, ":", port),
        title=cat("New destination: ", src, " → ", dst, ":", port, where),
        description=cat(src, " reached ", dst, ":", port, "/", F.col("protocol"), where,
                        " for the first time."),
        action=cat("Verify that ", dst, " is expected."), rationale="first sight of this destination",
        extra={"remote_ip": dst, "remote_port": port, "protocol": F.col("protocol"),
               "process": F.col("process_name"), "country": F.col("country")},
        explanation=explain(evidence("destination", cat(dst, ":", port, "/", F.col("protocol")),
                                     comparison="first-seen", baseline="destinations of this host"),
                            basis="0.6 for a first-seen destination"))


def new_listener(sockets: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Listening ports that the first snapshot did not have."""
    listen = F.col("state") == "LISTEN"
    cols = ["local_ip", "protocol", "process_name", "pid"]
    row = F.struct("us", "event_id", *cols)
    ports = (sockets.groupBy("local_port")
             .agg(F.min("us").alias("_any"),
                  F.min_by(row, F.when(listen, F.struct("us", "event_id"))).alias("_f"),
                  F.max(listen).alias("_listens")))
    # One row per port, so at most 65,536 rows meet in this window.
    started = ports.withColumn("_start", F.min("_any").over(Window.partitionBy()))
    fresh = (started.where(F.col("_listens") & (F.col("_f.us") > F.col("_start")))
             .select("local_port", "_f.*"))
    port, proto = F.col("local_port"), F.col("protocol")
    wide = F.col("local_ip").isin("0.0.0.0", "::")
    who = F.when(F.coalesce("process_name", F.lit("")) != "", F.col("process_name")).otherwise("unknown")
    return to_alerts(
        fresh, category="process_anomaly", affected=F.col("local_ip"), confidence=0.85,
        severity=F.when(port.isin(tables.SUSPICIOUS_PORTS), "medium").otherwise("low"),
        dedup_key=cat("new_listen:", port),
        title=cat("New listening port: ", port, "/", proto, " (", who, ")"),
        description=cat("A service listens on ", port, "/", proto, " at ",
                        F.when(wide, "all interfaces").otherwise(F.col("local_ip")), "."),
        action=cat("Verify that port ", port, " is expected."), rationale="absent from the first snapshot",
        extra={"port": port, "process": F.col("process_name"), "pid": F.col("pid"),
               "all_interfaces": wide},
        explanation=explain(evidence("listening_port", cat(port, "/", proto),
                                     comparison="not-in-baseline", baseline="ports of the first snapshot"),
                            basis="0.85 for a new listener"))


def host_countries(conn: DataFrame, prefixes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """First connection of each local host to each country."""
    src, dst = F.col("src_ip"), F.col("dst_ip")
    rows = conn.where(ip_in_subnets(src, cfg.subnets) & ~is_private_ip(dst) & (dst != "")
                      & not_allowed(dst, cfg.allow_ips)).select("event_id", "us", "src_ip", "dst_ip")
    # Reduced to one row per (host, address) before the country is looked up.
    firsts = first_rows(rows, ["src_ip", "dst_ip"])
    placed = geo_lookup(firsts, "dst_ip", prefixes).where("country != ''")
    return first_rows(placed, ["src_ip", "country"])


def new_country(conn: DataFrame, prefixes: DataFrame, cfg: Config = Config(),
                baseline: DataFrame | None = None, devices: DataFrame | None = None) -> DataFrame:
    """First connection of a local host to a country, after learning."""
    fresh = not_in_baseline(host_countries(conn, prefixes, cfg), baseline, ["src_ip", "country"])
    fired = with_hostname(after_learning(fresh, cfg), devices, "src_ip")
    src, code = F.col("src_ip"), F.col("country")
    name = F.when(F.col("country_name") != "", F.col("country_name")).otherwise(code)
    return to_alerts(
        fired, category="connection_anomaly", severity="medium", affected=src,
        related=F.col("dst_ip"), confidence=0.5, dedup_key=cat("newcountry:", src, ":", code),
        title=cat("New country for ", src, suffix(F.col("hostname")), ": ", name),
        description=cat(src, " reached ", name, " (", code, ") for the first time."),
        action=cat("Check whether ", name, " is expected."), rationale="first connection to this country",
        extra={"country": code, "country_name": name, "dst_ip": F.col("dst_ip")},
        explanation=explain(evidence("destination_country", code, comparison="first-seen",
                                     baseline="countries of this host"), basis="0.5 for a new country"))


def active_hours(conn: DataFrame, cfg: Config = Config(), baseline: DataFrame | None = None,
                 devices: DataFrame | None = None) -> DataFrame:
    """A local host active in an hour of day it never used, once enough hours are known.

    `baseline` has (src_ip, hour).
    """
    rows = (conn.where(ip_in_subnets(F.col("src_ip"), cfg.subnets))
            .select("event_id", "us", "src_ip", hour_of_day(F.col("us")).alias("hour")))
    fresh = first_seen(rows, ["src_ip"], "hour", baseline).where(F.col("known") >= cfg.hours_min_known)
    fired = with_hostname(after_learning(fresh, cfg), devices, "src_ip")
    src, hour, known = F.col("src_ip"), F.col("hour"), F.col("known")
    clock = F.format_string("%02d:00", hour)
    return to_alerts(
        fired, category="connection_anomaly", severity="medium", affected=src, confidence=0.5,
        dedup_key=cat("activehour:", src, ":", hour),
        title=cat("Unusual activity hour for ", src, suffix(F.col("hostname")), ": ", clock),
        description=cat(src, " was never active at ", clock, " UTC; ", known, " other hours are known."),
        action=cat("Check what is active on ", src, "."), rationale="first activity in this hour",
        extra={"hour": hour, "known_hours": known},
        explanation=explain(evidence("activity_hour", cat(clock, " UTC"), comparison="not-in-profile",
                                     baseline=cat(known, " active hours of this host")),
                            basis="0.5 for a new hour of an established profile"))


def profile_values(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows (src_ip, dimension, value): destination port, local peer, protocol, byte range."""
    src, dst, size = F.col("src_ip"), F.col("dst_ip"), F.col("size")
    dims = [
        ("dst_port", F.when(F.coalesce("dst_port", F.lit(0)) != 0, F.col("dst_port").cast("string"))),
        ("peer", F.when((dst != "") & (dst != src) & ip_in_subnets(dst, cfg.subnets), dst)),
        ("protocol", F.nullif(F.col("protocol"), F.lit(""))),
        ("byte_range", F.when(size > 0, byte_bucket(size))),
    ]
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), v.alias("value")) for n, v in dims])
    return (conn.where(ip_in_subnets(src, cfg.subnets)).select("event_id", "us", "src_ip",
                                                               F.explode(pairs).alias("_d"))
            .select("event_id", "us", "src_ip", "_d.*").where(F.col("value").isNotNull()))


# Title per profile dimension.
_TITLES = {"dst_port": "Off-profile destination port for ", "peer": "Off-profile internal peer for ",
           "protocol": "Off-profile protocol for ", "byte_range": "Off-profile transfer size for "}


def off_profile(conn: DataFrame, cfg: Config = Config(), baseline: DataFrame | None = None,
                devices: DataFrame | None = None, dimensions: tuple[str, ...] = tuple(_TITLES)) -> DataFrame:
    """First use of a value outside an established profile; all dimensions share one plan.

    `baseline` has (src_ip, dimension, value).
    """
    need = {"dst_port": cfg.ports_min_known, "peer": cfg.peers_min_known,
            "protocol": cfg.protocols_min_known, "byte_range": cfg.byte_ranges_min_known}
    rows = profile_values(conn, cfg).where(F.col("dimension").isin(list(dimensions)))
    fresh = first_seen(rows, ["src_ip", "dimension"], "value", baseline)
    dim, src, value, known = (F.col(c) for c in ("dimension", "src_ip", "value", "known"))
    enough, title = F.lit(False), None
    for d in dimensions:
        enough = enough | ((dim == d) & (known >= need[d]))
        title = (F.when(dim == d, _TITLES[d]) if title is None else title.when(dim == d, _TITLES[d]))
    fired = after_learning(fresh.where(enough), cfg)
    fired = with_hostname(with_hostname(fired, devices, "src_ip"), devices, "value", "peer_name")
    peer = F.when(dim == "peer", suffix(F.col("peer_name"))).otherwise("")
    return to_alerts(
        fired, category="connection_anomaly", severity="medium", affected=src,
        related=F.when(dim == "peer", value).otherwise(""), confidence=0.5,
        dedup_key=cat("hostprofile:", dim, ":", src, ":", value),
        title=cat(title, src, suffix(F.col("hostname")), ": ", value, peer),
        description=cat(src, " used ", dim, " ", value, " for the first time; ", known,
                        " other values are known."),
        action=cat("Confirm that this is expected of ", src, "."),
        rationale=cat("first ", dim, " ", value, " of ", src),
        extra={"dimension": dim, "value": value, "known": known},
        explanation=explain(evidence(cat("host_", dim), value, comparison="not-in-profile",
                                     baseline=cat(known, " ", dim, " value(s) of this host")),
                            basis="0.5 for a new value of an established profile"))
