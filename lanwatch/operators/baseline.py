"""Baseline tables: plain aggregates that can be merged across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SECOND, Config
from ..functions.moments import hour_of_day, weekday
from .dns import analysed
from .profile import host_countries as first_countries, profile_values
from .volume import connection_counts


def stats_agg(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sum of squared deviations per key: the mergeable form of running stats."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))


def stats_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Merge two stats tables exactly: deviations within plus deviations between the means."""
    both = a.unionByName(b)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    parts = F.collect_list(F.struct("n", "mean", "m2"))  # two rows per key at most
    merged = both.groupBy(*keys).agg(n.cast("bigint").alias("n"), mean.alias("mean"), parts.alias("_p"))
    m2 = F.aggregate("_p", F.lit(0.0),
                     lambda acc, p: acc + p["m2"] + p["n"] * F.pow(p["mean"] - F.col("mean"), 2))
    return merged.withColumn("m2", m2).drop("_p")


def stddev(n, m2):
    """Population deviation; 0 below two samples."""
    return F.when(n >= 2, F.sqrt(m2 / n)).otherwise(F.lit(0.0))


def hourly_baseline(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Mean and deviation of connection counts per (host, hour, weekday)."""
    return hourly_of(connection_counts(conn, cfg))


def hourly_of(minutes: DataFrame) -> DataFrame:
    """The same from counts (src_ip, us, n) per host and minute."""
    counts = minutes.select(
        F.col("src_ip").alias("ip"), hour_of_day(F.col("us")).alias("hour_of_day"),
        weekday(F.col("us")).alias("day_of_week"), "n", "us")
    return counts.groupBy("ip", "hour_of_day", "day_of_week").agg(
        F.avg("n").alias("avg_conn"), F.stddev_pop("n").alias("stddev_conn"),
        F.count("*").alias("sample_count"), F.max("us").alias("updated_at"))


def destination_baseline(conn: DataFrame) -> DataFrame:
    return conn.groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(
        F.count("*").alias("hit_count"), F.min("us").alias("first_seen"),
        F.max("us").alias("last_seen"))


def dns_baseline(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    return analysed(dns, cfg).groupBy("domain").agg(
        F.count("*").alias("query_count"), F.min("us").alias("first_seen"),
        F.max("us").alias("last_seen"))


def host_countries(conn: DataFrame, prefixes: DataFrame, cfg: Config = Config()) -> DataFrame:
    return first_countries(conn, prefixes, cfg).select(
        "src_ip", "country", F.col("us").alias("first_seen"))


def host_hours(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    from ..functions.net import ip_in_subnets
    return (conn.where(ip_in_subnets(F.col("src_ip"), cfg.subnets))
            .groupBy(F.col("src_ip").alias("ip"), hour_of_day(F.col("us")).alias("hour"))
            .agg(F.min("us").alias("first_seen")))


def host_profile(conn: DataFrame, cfg: Config = Config()) -> DataFrame:
    return profile_values(conn, cfg).groupBy(
        F.col("src_ip").alias("ip"), "dimension", "value").agg(F.min("us").alias("first_seen"))


# Merge rule per baseline column.
_MERGE = {"hit_count": F.sum, "query_count": F.sum, "first_seen": F.min, "last_seen": F.max}


def merge_baseline(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Yesterday's table with today's aggregates: counts add up, first and last widen."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(
        *[_MERGE[c](c).alias(c) for c in old.columns if c not in keys])


def baseline_summary(domains: DataFrame, destinations: DataFrame, hourly: DataFrame,
                     listeners: DataFrame, now_us: int, cfg: Config = Config()) -> DataFrame:
    """One row: learning state and sizes of the baselines. Each size is one partial aggregate."""
    end = cfg.learning_end_us
    left = 0.0 if end is None else max(0.0, (end - now_us) / (3600 * SECOND))
    def size(df, name):
        return df.agg(F.count("*").alias("v")).select(F.lit(name).alias("k"), F.col("v"))
    sizes = (size(domains, "known_domains").unionByName(size(destinations, "known_destinations"))
             .unionByName(hourly.agg(F.count_distinct("ip").alias("v"))
                          .select(F.lit("tracked_hosts").alias("k"), "v"))
             .unionByName(listeners.agg(F.count_distinct("local_port").alias("v"))
                          .select(F.lit("known_listening_ports").alias("k"), "v")))
    one = sizes.groupBy().agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in (
        "known_domains", "known_destinations", "tracked_hosts", "known_listening_ports")])
    return one.select(F.lit(left > 0).alias("is_learning"),
                      F.lit(float(left)).alias("learning_hours_remaining"), "*")


def known_ports(sockets: DataFrame) -> DataFrame:
    """Sorted set of listening ports (a port is 16 bits, so the array is bounded)."""
    return (sockets.where("state = 'LISTEN'").select("local_port").distinct()
            .agg(F.sort_array(F.collect_list("local_port")).alias("ports")))
