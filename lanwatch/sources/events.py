"""Event tables, batch and streaming, in one canonical shape.

Every event row has `us` (event time, microseconds since 1970 UTC) and `event_id` (order of rows
with equal time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import SECOND
from ..functions import tables
from ..functions.moments import to_us
from ..functions.names import strip_dots
from ..functions.net import lookup, normalize_mac

SCHEMAS = {
    "connections": "ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, "
                   "protocol string, flags string, size bigint, sensor string",
    "dns": "ts timestamp, src_ip string, dst_ip string, query_name string, query_type string, "
           "is_response boolean, response_ip string, is_nxdomain boolean",
    "arp": "ts timestamp, op int, src_mac string, src_ip string, dst_mac string, dst_ip string",
    "socket_snapshots": "ts timestamp, local_ip string, local_port int, remote_ip string, "
                        "remote_port int, state string, protocol string, inode bigint, pid int, "
                        "process_name string",
    "arp_snapshots": "ts timestamp, ip string, mac string, interface string, flags string",
    "iface_counters": "ts timestamp, name string, rx_bytes bigint, rx_packets bigint, "
                      "tx_bytes bigint, tx_packets bigint, rx_errors bigint, tx_errors bigint",
    "auth_events": "ts timestamp, event_kind string, usr string, src_ip string, command string, line string",
}


def canonical(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add `us`, and `event_id` (a hash of the row) where absent."""
    out = df.withColumn("us", to_us(F.col(ts))) if "us" not in df.columns else df
    if "event_id" not in df.columns:
        out = out.withColumn("event_id", F.xxhash64(*[c for c in out.columns]))
    return out


def read_events(spark: SparkSession, kind: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A bounded event table. The schema is fixed, so nothing is inferred or scanned twice."""
    return canonical(spark.read.format(fmt).schema(SCHEMAS[kind]).options(**options).load(path))


def stream_events(spark: SparkSession, kind: str, path: str, fmt: str = "parquet",
                  lateness: str = "2 minutes", **options) -> DataFrame:
    """The same table as a stream with a watermark on `ts`."""
    raw = spark.readStream.format(fmt).schema(SCHEMAS[kind]).options(**options).load(path)
    return canonical(raw.withWatermark("ts", lateness))


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """Text lines with `line_no`, which sorts them by file and position."""
    options = {"lineSep": line_sep} if line_sep else {}
    return spark.read.options(**options).text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.file_block_start").alias("block"),
                          F.monotonically_increasing_id().alias("n")).alias("line_no"))


def normalise_dns(dns: DataFrame) -> DataFrame:
    """Clean names (names shorter than four characters drop out) and name numeric query types."""
    qtype = F.coalesce(lookup(F.expr("try_cast(query_type as int)"), tables.DNS_QTYPES), F.col("query_type"))
    return (dns.withColumn("query_name", strip_dots(F.col("query_name")))
            .where(F.length("query_name") >= 4).withColumn("query_type", qtype))


def arp_from_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of an ARP-table snapshot as replies; incomplete entries (zero MAC) drop out."""
    mac = normalize_mac(F.col("mac"))
    return snapshots.where(mac != "00:00:00:00:00:00").select(
        "event_id", "us", F.lit(2).alias("op"), F.col("ip").alias("src_ip"), mac.alias("src_mac"),
        F.lit("ff:ff:ff:ff:ff:ff").alias("dst_mac"), F.lit("0.0.0.0").alias("dst_ip"))


def new_in_snapshot(df: DataFrame, keys: list[str], snapshot: str,
                    snapshots: DataFrame | None = None) -> DataFrame:
    """Rows whose key the preceding snapshot lacks; the first snapshot emits nothing.

    `snapshots` lists all snapshot times when some may be empty. The time before is found in two levels: inside a
    day by lag, for the first of a day among the last times of the days (one number a day). The comparison is an
    anti-join on (key, preceding time). `snapshot` counts microseconds.
    """
    times = (snapshots if snapshots is not None else df).select(snapshot).distinct().withColumn(
        "_day", F.floor(F.col(snapshot) / 86_400_000_000))
    inside = times.withColumn("_prev", F.lag(snapshot).over(Window.partitionBy("_day").orderBy(snapshot)))
    ends = times.groupBy("_day").agg(F.max(snapshot).alias("_end")).groupBy(F.lit(0).alias("_all")).agg(F.collect_list("_end").alias("_ends"))
    first = inside.where(F.col("_prev").isNull()).withColumn("_all", F.lit(0)).join(ends, "_all").withColumn(
        "_prev", F.array_max(F.filter("_ends", lambda e: e < F.col(snapshot))))
    before = inside.where(F.col("_prev").isNotNull()).select(snapshot, "_prev").unionByName(first.select(snapshot, "_prev"))
    rows = df.dropDuplicates([*keys, snapshot])
    now = rows.join(before.where(F.col("_prev").isNotNull()), snapshot)
    last = rows.select(*keys, F.col(snapshot).alias("_prev"))
    return now.join(last, [*keys, "_prev"], "left_anti").select(*df.columns)
