"""Writers, retention and export formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import SECOND
from ..functions import tables
from ..functions.alerting import at_least, source_destination
from ..functions.moments import from_us, iso_utc
from ..functions.names import once
from ..functions.net import lookup

PRODUCT = "lanwatch"
_DAY = 86400 * SECOND


def with_day(df: DataFrame, ts: str = "us") -> DataFrame:
    return df.withColumn("dt", F.to_date(from_us(F.col(ts))))


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts, partitioned by day. A later write of an alert_id replaces it on read."""
    (with_day(alerts).withColumn("written", F.unix_micros(F.current_timestamp()))
     .write.mode("append").partitionBy("dt").parquet(path))


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The last written row per alert_id."""
    rows = spark.read.parquet(path)
    body = [c for c in rows.columns if c not in ("alert_id", "written", "dt")]
    return rows.groupBy("alert_id").agg(F.max_by(F.struct(*body), "written").alias("_r")).select(
        "alert_id", "_r.*")


def write_dns_obs(dns: DataFrame, path: str) -> None:
    """Append one row per analysed query, partitioned by day."""
    (with_day(dns.select("us", "src_ip", F.col("domain").alias("query_name"), "query_type",
                         "response_ip", "is_nxdomain"))
     .write.mode("append").partitionBy("dt").parquet(path))


def keep_recent(df: DataFrame, ts: str, now_us: int, days: int = 30) -> DataFrame:
    """Rows not older than `days`."""
    return df.where(F.col(ts) >= now_us - days * _DAY)


def purge(spark: SparkSession, path: str, ts: str, now_us: int, days: int = 30) -> None:
    """Drop rows older than `days` from a day-partitioned table.

    Older day directories go as a whole; only the boundary day is rewritten.
    """
    cutoff = now_us - days * _DAY
    table = spark.read.parquet(path)
    boundary = F.to_date(from_us(F.lit(cutoff)))
    edge = table.where(F.col("dt") == boundary)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    day = spark.range(1).select(boundary.cast("string")).first()[0]
    if edge.where(F.col(ts) >= cutoff).limit(1).count():
        (edge.where(F.col(ts) >= cutoff).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path))
        last = "dt < '%s'" % day
    else:
        last = "dt <= '%s'" % day
    for row in table.where(last).select("dt").distinct().collect():  # one row per expired day
        fs.delete(hadoop.Path(f"{path}/dt={row[0]}"), True)


def _number(severity: str, values: dict, default: int) -> Column:
    return lookup(F.col(severity), values, default)


def _ends() -> Column:
    return source_destination(F.col("category"), F.col("affected_host"), F.col("affected_mac"),
                              F.col("related_host"))


def _confidence() -> Column:
    return F.round(F.col("confidence").cast("double"), 3)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def to_ecs(alerts: DataFrame, version: str = "1.0.0", product: str = PRODUCT) -> DataFrame:
    """One ECS JSON document per alert in `value`."""
    df = once(alerts, _e=_ends())
    categories = F.create_map(*[x for k, v in tables.ECS_CATEGORIES.items()
                                for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    src, mac, dst = (_filled(F.col(f"_e.{c}")) for c in ("ip", "mac", "dest"))
    extra = F.when(F.col("extra") != "{}", F.try_parse_json("extra"))
    doc = F.struct(
        iso_utc(F.col("us")).alias("@timestamp"), F.col("title").alias("message"),
        F.struct(F.lit("8.11.0").alias("version")).alias("ecs"),
        F.struct(
            F.col("alert_id").alias("id"), F.lit("alert").alias("kind"),
            F.coalesce(F.try_element_at(categories, F.col("category")),
                       F.array(F.lit("network"))).alias("category"),
            F.array(F.lit("info")).alias("type"), F.col("category").alias("action"),
            _number("severity", tables.ECS_SEVERITY, 1).alias("severity"),
            F.col("description").alias("reason"), F.lit(product).alias("module"),
            F.lit(f"{product}.alert").alias("dataset")).alias("event"),
        F.struct(F.col("severity").alias("level")).alias("log"),
        F.struct(F.lit(product).alias("vendor"), F.lit(product).alias("product"),
                 F.lit("ids").alias("type"), F.lit(version).alias("version")).alias("observer"),
        F.struct(F.col("category").alias("name"), F.lit(product).alias("ruleset")).alias("rule"),
        F.struct(_confidence().alias("confidence"), "confidence_rationale",
                 "recommended_action", "dedup_key", extra.alias("extra")).alias(product),
        F.when(src.isNotNull(), F.struct(src.alias("ip"), mac.alias("mac"))).alias("source"),
        F.when(src.isNotNull(), F.struct(F.col("affected_host").alias("ip"),
                                         F.lit(None).cast("string").alias("mac")))
        .when(mac.isNotNull(), F.struct(F.lit(None).cast("string").alias("ip"), mac.alias("mac")))
        .alias("host"),
        F.when(dst.isNotNull(), F.struct(dst.alias("ip"))).alias("destination"))
    return df.select("alert_id", F.to_json(doc).alias("value"))


def _cef_header(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def _cef_value(c: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("=", "\\="), ("\n", "\\n"), ("\r", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def to_cef(alerts: DataFrame, version: str = "1.0.0", product: str = PRODUCT) -> DataFrame:
    """One CEF line per alert in `value`."""
    df = once(alerts, _e=_ends())
    title = F.coalesce(_filled(F.col("title")), F.col("category"))
    header = F.concat_ws("|", *[_cef_header(c) for c in (
        F.lit("CEF:0"), F.lit(product), F.lit(product), F.lit(version), F.col("category"), title,
        _number("severity", tables.CEF_SEVERITY, 1).cast("string"))])
    action = _filled(F.col("recommended_action"))
    pairs = [("externalId", F.col("alert_id")), ("rt", iso_utc(F.col("us"))), ("cat", F.col("category")),
             ("src", _filled(F.col("_e.ip"))), ("smac", _filled(F.col("_e.mac"))),
             ("dst", _filled(F.col("_e.dest"))), ("msg", _filled(F.col("description"))),
             ("cn1", _confidence().cast("string")), ("cn1Label", F.lit("confidence")),
             ("cs1", action), ("cs1Label", F.when(action.isNotNull(), "recommendedAction"))]
    body = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), _cef_value(v)) for k, v in pairs])
    return df.select("alert_id", F.concat(header, F.lit("|"), body).alias("value"))


def to_syslog(lines: DataFrame, alerts: DataFrame, facility: str = "local0", host: str = "",
              product: str = PRODUCT) -> DataFrame:
    """RFC 5424 frames around payload lines (`alert_id`, `value`) of the given alerts."""
    pri = tables.SYSLOG_FACILITIES.get(facility, 16) * 8 + _number("severity", tables.SYSLOG_SEVERITY, 5)
    framed = lines.join(alerts.select("alert_id", "severity", "us"), "alert_id")
    return framed.select("alert_id", F.concat(
        F.lit("<"), pri.cast("string"), F.lit(">1 "), iso_utc(F.col("us")),
        F.lit(f" {host or '-'} {product} - - - "), F.col("value")).alias("value"))


def to_syslog_lines(alerts: DataFrame, facility: str = "local0", host: str = "", fmt: str = "ecs",
                    product: str = PRODUCT) -> DataFrame:
    """Syslog frames with an ECS or CEF payload."""
    payload = to_cef(alerts, product=product) if fmt == "cef" else to_ecs(alerts, product=product)
    return to_syslog(payload, alerts, facility, host, product)


def to_otlp(alerts: DataFrame, host: str = "", version: str = "1.0.0", product: str = PRODUCT) -> DataFrame:
    """One OTLP logs envelope (JSON) per alert in `value`."""
    df = once(alerts, _e=_ends())
    nothing = F.lit(None).cast("string")

    def attribute(key: str, text: Column, number: Column | None = None) -> Column:
        present = (number if number is not None else _filled(text)).isNotNull()
        value = F.struct(_filled(text).alias("stringValue"),
                         (number if number is not None else F.lit(None).cast("double")).alias("doubleValue"))
        return F.when(present, F.struct(F.lit(key).alias("key"), value.alias("value")))

    def attributes(items: list[Column]) -> Column:
        return F.filter(F.array(*items), lambda a: a.isNotNull())

    record = attributes([
        attribute("event.id", F.col("alert_id")), attribute("event.category", F.col("category")),
        attribute("event.action", F.col("category")), attribute("event.severity", F.col("severity")),
        attribute("source.ip", F.col("_e.ip")), attribute("source.mac", F.col("_e.mac")),
        attribute("destination.ip", F.col("_e.dest")),
        attribute(f"{product}.confidence", nothing, _confidence()),
        attribute(f"{product}.confidence_rationale", F.col("confidence_rationale")),
        attribute(f"{product}.recommended_action", F.col("recommended_action")),
        attribute(f"{product}.dedup_key", F.col("dedup_key")),
        attribute(f"{product}.description", F.col("description")),
        attribute(f"{product}.extra", F.when(F.col("extra") != "{}", F.col("extra")))])
    resource = attributes([attribute("service.name", F.lit(product)),
                           attribute("service.version", F.lit(version)), attribute("host.name", F.lit(host))])
    nanos = (F.col("us") * 1000).cast("string")
    log = F.struct(
        nanos.alias("timeUnixNano"), nanos.alias("observedTimeUnixNano"),
        _number("severity", tables.OTLP_SEVERITY_NUMBER, 9).alias("severityNumber"),
        lookup(F.col("severity"), tables.OTLP_SEVERITY_TEXT, "INFO").alias("severityText"),
        F.struct(F.col("title").alias("stringValue")).alias("body"), record.alias("attributes"))
    scope = F.struct(F.struct(F.lit(product).alias("name"), F.lit(version).alias("version")).alias("scope"),
                     F.array(log).alias("logRecords"))
    doc = F.struct(F.array(F.struct(F.struct(resource.alias("attributes")).alias("resource"),
                                    F.array(scope).alias("scopeLogs"))).alias("resourceLogs"))
    return df.select("alert_id", F.to_json(doc).alias("value"))


def alert_json(extra: bool = True) -> Column:
    """Alert as a JSON object, as channels and sensors send it."""
    return F.struct(
        "alert_id", iso_utc(F.col("us")).alias("timestamp"), "severity", "category", "affected_host",
        "affected_mac", "related_host", "title", "description", "recommended_action",
        _confidence().alias("confidence"), "confidence_rationale", "dedup_key",
        F.try_parse_json("extra").alias("extra"))


def export_alerts(alerts: DataFrame, min_severity: str = "info", fmt: str = "json") -> DataFrame:
    """Lines (`value`) of the alerts at or above a severity, as json, ecs, cef, syslog or otlp."""
    rows = alerts.where(at_least(F.col("severity"), min_severity))
    if fmt == "json":
        return rows.select("alert_id", F.to_json(alert_json()).alias("value"))
    return {"ecs": to_ecs, "cef": to_cef, "syslog": to_syslog_lines, "otlp": to_otlp}[fmt](rows)


def forwardable(alerts: DataFrame, sensor_id: str, floor: str = "low") -> DataFrame:
    """Messages for a collector: own alerts at or above the floor; tagged ones never travel on."""
    rows = alerts.where(at_least(F.col("severity"), floor) & F.col("sensor").isNull())
    return rows.select("alert_id", F.to_json(F.struct(
        F.lit(sensor_id).alias("sensor_id"), alert_json().alias("alert"))).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    lines.select("value").write.mode(mode).text(path)
