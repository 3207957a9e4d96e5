"""Parsers of log lines and feeds. Input: rows with `value` (and `line_no` where order counts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import tables
from ..functions.moments import to_us
from ..functions.names import once, url_host
from ..functions.net import ip_hex, is_valid_ip, lookup, normalize_mac

def _port(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def _parsed(lines: DataFrame, source: Column, parse, valid) -> DataFrame:
    """Replace `value` by the fields of `parse(source)`, for rows where they are valid.

    The fields come out of a generator, so each line is parsed once and not again for the filter.
    """
    found = F.filter(F.transform(F.array(source), parse), valid)
    return lines.select(*[c for c in lines.columns if c != "value"], F.inline(found))


def _addressed(flow: Column) -> Column:
    return (flow["protocol"] != "") & (flow["src_ip"] != "") & (flow["dst_ip"] != "")


def _flow(protocol, src_ip, src_port, dst_ip, dst_port) -> Column:
    return F.struct(src_ip.alias("src_ip"), src_port.alias("src_port"), dst_ip.alias("dst_ip"),
                    dst_port.alias("dst_port"), protocol.alias("protocol"), F.lit("").alias("flags"),
                    F.lit(0).cast("bigint").alias("size"))


def ingest_conntrack(lines: DataFrame) -> DataFrame:
    """Connection-tracking lines: first protocol token and first (original direction) tuple."""
    def parse(line: Column) -> Column:
        def first(pattern: str) -> Column:
            return F.regexp_extract(line, pattern, 1)
        return _flow(first(r"\b(tcp|udp|icmp)\b"), first(r"\bsrc=(\S+)"), _port(first(r"\bsport=(\d+)")),
                     first(r"\bdst=(\S+)"), _port(first(r"\bdport=(\d+)")))
    return _parsed(lines, F.col("value"), parse, _addressed)


def ingest_filterlog(lines: DataFrame) -> DataFrame:
    """Firewall filter lines: CSV after `filterlog...:` or bare; the IP version picks the layout."""
    value = F.col("value")
    tail = F.expr("substr(value, instr(value, 'filterlog'))")
    body = F.when(F.instr(value, "filterlog") > 0, F.when(
        F.instr(tail, ":") > 0, F.trim(F.substring(tail, F.instr(tail, ":") + 1, F.length(tail)))
    ).otherwise("")).otherwise(F.trim(value))

    def parse(fields: Column) -> Column:
        version = F.get(fields, F.lit(8))

        def at(v4: int, v6: int) -> Column:
            return F.get(fields, F.when(version == "4", v4).when(version == "6", v6))

        protocol = F.lower(at(16, 12))

        def port(v4: int, v6: int) -> Column:
            text = at(v4, v6)
            return F.when(protocol.isin("tcp", "udp") & text.rlike(r"^\d+$"), _port(text)).otherwise(F.lit(0))

        return _flow(F.coalesce(protocol, F.lit("")), at(18, 15), port(20, 17), at(19, 16), port(21, 18))

    return _parsed(lines, F.split(body, ","), parse,
                   lambda f: (f["src_ip"] != "") & (f["dst_ip"] != ""))


def ingest_flow_export(df: DataFrame) -> DataFrame:
    """Decoded flow-export rows: protocol number to name (else its text), flags empty."""
    return df.where("src_ip != '' and dst_ip != ''").withColumn("protocol", F.coalesce(
        lookup(F.col("protocol_number").cast("int"), tables.IP_PROTOCOLS),
        F.col("protocol_number").cast("string"))).withColumn("flags", F.lit("")).drop("protocol_number")


def ingest_auth_log(lines: DataFrame, year: int, now_us: int | None = None) -> DataFrame:
    """Authentication log lines to events.

    Lines carry no year: `year` is used, and one year less when that lies after `now_us`.
    """
    p = tables.AUTH_PATTERNS
    logins = ["ssh_failure", "ssh_invalid_user", "ssh_success"]

    def parse(line: Column) -> Column:
        # Tested in this order; the first matching pattern decides.
        kind = reduce(lambda c, k: c.when(line.rlike(p[k]), k), [k for k in p if k != "ssh_failure"],
                      F.when(line.rlike(p["ssh_failure"]), "ssh_failure"))
        return F.struct(line.alias("line"), kind.alias("kind"))

    def detail(row: Column) -> Column:
        line, kind = row["line"], row["kind"]

        def group(n: int, kinds: list[str]) -> Column:
            cases = [(kind == k, F.regexp_extract(line, p[k], n)) for k in kinds]
            return reduce(lambda c, case: c.when(*case), cases[1:], F.when(*cases[0]))

        def at(y: int) -> Column:
            text = F.concat(F.lit(f"{y} "), F.regexp_replace(F.substring(line, 1, 15), " +", " "))
            return to_us(F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss")))

        us = at(year) if now_us is None else F.when(at(year) > now_us, at(year - 1)).otherwise(at(year))
        return F.struct(
            us.alias("us"), F.when(kind == "ssh_invalid_user", "ssh_failure").otherwise(kind).alias("event_kind"),
            group(1, logins + ["new_user"]).alias("usr"), group(2, logins).alias("src_ip"),
            group(1, ["sudo"]).alias("command"), line.alias("line"))

    known = F.filter(F.transform(F.array(F.trim("value")), parse), lambda r: r["kind"].isNotNull())
    out = lines.select(*[c for c in lines.columns if c != "value"], F.inline(F.transform(known, detail)))
    return out if "event_id" in out.columns else out.withColumn("event_id", F.xxhash64("us", "line"))


def parse_line_list(lines: DataFrame) -> DataFrame:
    """First token per line; `#` lines and blank lines drop out."""
    text = F.trim("value")
    return lines.where((text != "") & ~text.startswith("#")).withColumn(
        "value", F.regexp_extract(text, r"^(\S+)", 1))


def parse_drop_list(lines: DataFrame) -> DataFrame:
    """`CIDR ; note` per line; `;` lines drop out."""
    text = F.trim("value")
    token = F.trim(F.substring_index(text, ";", 1))
    return lines.where((token != "") & ~text.startswith(";")).withColumn("value", token)


def parse_url_list(lines: DataFrame) -> DataFrame:
    """Host of each URL; `#` lines drop out."""
    text = F.trim("value")
    return (lines.where((text != "") & ~text.startswith("#")).withColumn("value", url_host(text))
            .where("value != ''"))


# Parser per feed; the order of `feeds` decides which feed wins an equal value.
_FEED_PARSERS = {"feodo": parse_line_list, "spamhaus_drop": parse_drop_list, "urlhaus": parse_url_list}


def valid_cidr(c: Column) -> Column:
    host, bits = F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2)).try_cast("int")
    return F.coalesce(bits.between(0, F.length(ip_hex(host)) * 4), F.lit(False))


def build_indicators(feeds: list[tuple[str, DataFrame]]) -> DataFrame:
    """Indicator catalogue from (feed name, lines); unknown feeds are ignored.

    A later feed overwrites an equal address or domain. Networks all stay, in feed order.
    """
    parts = []
    for rank, (name, lines) in enumerate(feeds):
        if name not in tables.FEEDS:
            continue
        kind, category = tables.FEEDS[name]
        value, k = F.col("value"), F.col("kind")
        v = F.when(k == "domain", F.lower(value)).when((k == "cidr") & ~value.contains("/"), F.concat(
            value, F.when(value.contains(":"), "/128").otherwise("/32"))).otherwise(value)
        values = once(_FEED_PARSERS[name](lines).withColumnRenamed("value", "_raw"), value=F.col("_raw"))
        values = (once(values, kind=F.when(is_valid_ip(value), "ip").otherwise("domain")) if kind == "host"
                  else values.withColumn("kind", F.lit(kind)))
        parts.append(values.select(
            v.alias("value"), k.alias("kind"), F.lit(name).alias("source"),
            F.lit(category).alias("category"),
            F.struct(F.lit(rank).alias("feed"), F.col("line_no").alias("line")).alias("feed_order")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    single = rows.where("kind != 'cidr'").groupBy("kind", "value").agg(
        F.max_by(F.struct("source", "category", "feed_order"), "feed_order").alias("s")).select(
            "value", "kind", "s.*")
    return single.unionByName(rows.where((F.col("kind") == "cidr") & valid_cidr(F.col("value")))
                              .select(*single.columns))


def load_indicators(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Catalogue from feed files, in the order given."""
    from .events import read_lines
    return build_indicators([(name, read_lines(spark, path)) for name, path in paths.items()
                             if name in tables.FEEDS])


def indicator_counts(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("kind").agg(F.count("*").alias("indicators"))


def ingest_dhcp(lines: DataFrame, fmt: str = "dnsmasq") -> DataFrame:
    """DHCP leases keyed by MAC, the last line or block of a MAC wins.

    `dnsmasq`: `expiry mac ip host ...` per line. `isc`: text cut at `}` (read with that line
    separator), one `lease IP { ... }` block per row.
    """
    if fmt == "isc":
        block = r"(?s)lease\s+(\S+)\s*\{(.*)"
        body = F.regexp_extract("value", block, 2)
        rows = lines.select(
            F.regexp_extract("value", block, 1).alias("ip"),
            F.regexp_extract(body, r"hardware\s+ethernet\s+([0-9a-fA-F:]+)\s*;", 1).alias("mac"),
            F.regexp_extract(body, r'client-hostname\s+"([^"]*)"\s*;', 1).alias("hostname"),
            "line_no").where("ip != '' and mac != ''")
    else:
        parts = F.split(F.trim("value"), r"\s+")
        rows = lines.where(F.size(parts) >= 4).select(
            parts[2].alias("ip"), parts[1].alias("mac"),
            F.when(parts[3] == "*", "").otherwise(parts[3]).alias("hostname"), "line_no")
    mac = normalize_mac(F.col("mac"))
    return rows.groupBy(mac.alias("mac")).agg(
        F.max_by(F.struct("ip", "hostname"), "line_no").alias("l")).select("mac", "l.*")


SENSOR_MESSAGE = (
    "sensor_id string, alert struct<alert_id: string, timestamp: string, severity: string, "
    "category: string, affected_host: string, affected_mac: string, related_host: string, "
    "title: string, description: string, recommended_action: string, confidence: string, "
    "confidence_rationale: string, dedup_key: string, extra: string>")


def ingest_sensor_alerts(messages: DataFrame, received_us: Column) -> DataFrame:
    """JSON messages {sensor_id, alert} to alert rows tagged with their sensor.

    Bad severities become info, bad categories system, bad times the time of receipt, and a missing
    or zero confidence 1.0. Messages without an alert object drop out.
    """
    from ..functions.alerting import ALERT_COLUMNS, default_dedup_key

    def fields(message: Column) -> Column:
        a = message["alert"]

        def text(name: str) -> Column:
            return F.coalesce(a[name], F.lit(""))

        category = F.when(a["category"].isin(tables.CATEGORIES), a["category"]).otherwise("system")
        conf = a["confidence"].try_cast("double")
        return F.struct(
            F.nullif(a["alert_id"], F.lit("")).alias("alert_id"),
            to_us(a["timestamp"].try_cast("timestamp")).alias("us"),
            F.when(a["severity"].isin(tables.SEVERITIES), a["severity"]).otherwise("info").alias("severity"),
            category.alias("category"),
            *[text(c).alias(c) for c in ("affected_host", "affected_mac", "related_host", "title",
                                         "description", "recommended_action", "confidence_rationale")],
            F.when(F.coalesce(conf, F.lit(0.0)) != 0, conf).otherwise(1.0).alias("confidence"),
            default_dedup_key(a["dedup_key"], category, text("affected_host"), text("title")).alias("dedup_key"),
            F.lit("new").alias("status"), F.coalesce(a["extra"], F.lit("{}")).alias("extra"),
            F.coalesce(F.nullif(message["sensor_id"], F.lit("")), F.lit("unknown")).alias("sensor"))

    parsed = F.filter(F.array(F.from_json("value", SENSOR_MESSAGE)), lambda m: m["alert"].isNotNull())
    rows = messages.select(received_us.alias("_at"), F.col("value").alias("_raw"),
                           F.inline(F.transform(parsed, fields)))
    return rows.withColumn("us", F.coalesce("us", "_at")).withColumn(
        "alert_id", F.coalesce("alert_id", F.sha2("_raw", 256))).select(*ALERT_COLUMNS)
