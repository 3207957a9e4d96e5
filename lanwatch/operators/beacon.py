"""Regular outbound connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import SECOND, Config
from ..functions import tables
from ..functions.alerting import cat, evidence, explain, to_alerts
from ..functions.net import is_private_ip
from .firsts import known_in_baseline
from .lookup import not_allowed
from .suppress import cooldown

FLOW = ["src_ip", "dst_ip", "dst_port"]


BUCKET = 3600      # seconds of a flow that are ordered together
BLOCK_HISTORIES = 4  # length of a block of events, in histories


def _placed(rows: DataFrame, cfg: Config) -> DataFrame:
    """Events as (event_id, us, _flow, _b, _run, _at, _good): the bucket of time, the run of the flow, which starts anew
    after an idle gap, the place in the run, and the gap before the event in seconds, where it counts.

    Buckets are no longer than an idle gap, so a run can only begin with a bucket. Runs, places and the event before
    the first one of a bucket therefore follow from one short row a bucket; a struct as key keeps nulls together.
    """
    idle = cfg.beacon_idle * SECOND
    events = rows.where("us is not null").select(
        "event_id", F.col("us").cast("bigint").alias("us"), F.struct(*FLOW).alias("_flow"),
        F.floor(F.col("us") / min(idle, BUCKET * SECOND)).cast("bigint").alias("_b"))
    buckets = events.groupBy("_flow", "_b").agg(F.count("*").alias("_n"), F.min("us").alias("_first"), F.max("us").alias("_last"))
    along = Window.partitionBy("_flow").orderBy("_b")
    buckets = (buckets.withColumn("_prior", F.lag("_last").over(along))
               .withColumn("_prior", F.when(F.col("_first") - F.col("_prior") <= idle, F.col("_prior")))
               .withColumn("_run", F.count(F.when(F.col("_prior").isNull(), 1)).over(along.rowsBetween(Window.unboundedPreceding, 0))))
    ahead = Window.partitionBy("_flow", "_run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_flow", "_b", "_prior", "_run", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    order = Window.partitionBy("_flow", "_b").orderBy("us", "event_id")
    gap = (F.col("us") - F.coalesce(F.lag("us").over(order), "_prior")) / SECOND
    return (events.join(buckets, ["_flow", "_b"]).withColumn("_gap", gap)
            .withColumn("_at", F.col("_ahead") + F.row_number().over(order) - 1)
            .withColumn("_good", F.when(F.col("_gap") >= cfg.beacon_min_gap, F.col("_gap")))
            .select("event_id", "us", "_flow", "_b", "_run", "_at", "_good"))


_STATISTICS = ["intervals", "mean", "sd", "shortest", "longest"]


def _recent_gaps(placed: DataFrame, history: int) -> DataFrame:
    """Statistics over the gaps of the last `history` events. Runs are cut into blocks by place; the end of a block, one
    history long, is copied into the next."""
    width, before = BLOCK_HISTORIES * history, max(0, history - 2)
    block = F.floor(F.col("_at") / width).cast("bigint")
    late = F.col("_at") % width >= width - before
    blocks = placed.withColumn("_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    last = Window.partitionBy("_flow", "_run", "_block").orderBy("_at").rowsBetween(-before, 0)
    return (blocks.withColumns({"intervals": F.count("_good").over(last), "mean": F.avg("_good").over(last),
                                "sd": F.stddev_pop("_good").over(last), "shortest": F.min("_good").over(last),
                                "longest": F.max("_good").over(last)})
            .where(F.col("_block") == block))


def _all_gaps(placed: DataFrame) -> DataFrame:
    """Statistics over all gaps of the run so far: what earlier buckets add up to, and running sums in the bucket.

    Gaps and their squares are added in whole microseconds, so that no digits are lost over a long run.
    """
    exact = F.round(F.col("_good") * SECOND).cast("decimal(19,0)")
    sums = {"_n": F.count, "_s": F.sum, "_q": F.sum, "_low": F.min, "_high": F.max}
    both = {"_n": lambda a, b: a + b, "_s": lambda a, b: a + b, "_q": lambda a, b: a + b, "_low": F.least, "_high": F.greatest}
    values = placed.withColumns({"_n": F.col("_good"), "_s": exact, "_q": exact * exact, "_low": F.col("_good"), "_high": F.col("_good")})
    buckets = values.groupBy("_flow", "_run", "_b").agg(*[f(c).alias(c) for c, f in sums.items()])
    ahead = Window.partitionBy("_flow", "_run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    merge = {**sums, "_n": F.sum}
    buckets = buckets.select("_flow", "_b", *[f(c).over(ahead).alias(f"{c}0") for c, f in merge.items()])
    so_far = Window.partitionBy("_flow", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = values.join(buckets, ["_flow", "_b"])
    rows = rows.withColumns({c: f(c).over(so_far) for c, f in sums.items()})
    rows = rows.withColumns({c: F.coalesce(both[c](F.col(c), F.col(f"{c}0")), F.col(c), F.col(f"{c}0")) for c in sums})
    n, s, q = (F.col(c).cast("decimal(38,0)") for c in ("_n", "_s", "_q"))
    some = F.col("_n") > 0
    return rows.withColumns({
        "intervals": F.col("_n"), "mean": F.when(some, s.cast("double") / F.col("_n") / SECOND),
        "sd": F.when(some, F.sqrt((n * q - s * s).cast("double")) / F.col("_n") / SECOND), "shortest": F.col("_low"), "longest": F.col("_high")})


def flow_gaps(rows: DataFrame, cfg: Config) -> DataFrame:
    """Statistics of the gaps among a flow's last `beacon_history` events, or, where that is None, among all events so
    far; per event. A flow starts anew after `beacon_idle` seconds of silence; events without a time are left out.

    No task and no array holds a flow: events are ordered within buckets of an hour, then within blocks of a few
    histories; across them go one row a bucket and one history of rows a block.
    """
    placed = _placed(rows, cfg)
    found = _all_gaps(placed) if cfg.beacon_history is None else _recent_gaps(placed, cfg.beacon_history)
    return found.select("event_id", "us", "_flow.*", *_STATISTICS)


def beacon(conn: DataFrame, cfg: Config = Config(), baseline: DataFrame | None = None) -> DataFrame:
    """Outbound flows whose gaps vary little.

    A destination in `baseline` (src_ip, dst_ip, dst_port, protocol) lowers high to medium and the
    confidence by 0.15, outside the learning phase.
    """
    rows = outbound(conn, cfg)
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(F.lit(float("inf")))
    hits = (flow_gaps(rows, cfg).withColumn("cv", cv)
            .where((F.col("intervals") >= cfg.beacon_intervals)
                   & (F.col("mean") >= cfg.beacon_min_mean) & (F.col("cv") <= cfg.beacon_cv)))
    return beacon_alerts(cooldown(hits, FLOW, cfg.beacon_cooldown), cfg, baseline)


def outbound(conn: DataFrame, cfg: Config) -> DataFrame:
    """Connections that may be beacons: to the outside, neither allowed nor of services that are periodic anyway."""
    dst, port = F.col("dst_ip"), F.col("dst_port")
    return conn.where(not_allowed(port, tables.PERIODIC_PORTS) & not_allowed(port, cfg.allow_ports)
                      & not_allowed(dst, cfg.allow_ips) & ~is_private_ip(dst))


def beacon_alerts(fired: DataFrame, cfg: Config, baseline: DataFrame | None = None) -> DataFrame:
    """Alerts of fired rows (event_id, us, flow, intervals, mean, sd, shortest, longest, cv)."""
    dst, port = F.col("dst_ip"), F.col("dst_port")
    tcp = baseline.where("protocol = 'tcp'") if baseline is not None else None
    fired = known_in_baseline(fired, tcp, FLOW)
    known = F.col("known")
    if cfg.learning_end_us is not None:
        known = known & (F.col("us") >= cfg.learning_end_us)
    tier = F.when(F.col("cv") < 0.05, "high").when(F.col("cv") < 0.10, "medium").otherwise("low")
    conf = F.when(F.col("cv") < 0.05, 0.85).when(F.col("cv") < 0.10, 0.75).otherwise(0.65)
    src, mean, n = F.col("src_ip"), F.col("mean"), F.col("intervals")
    return to_alerts(
        fired, category="beacon",
        severity=F.when(known & (tier == "high"), "medium").otherwise(tier),
        affected=src, related=dst, confidence=F.round(conf - F.when(known, 0.15).otherwise(0.0), 2),
        dedup_key=cat("beacon:", src, ":", dst, ":", port),
        title=cat("Beacon pattern: ", src, " → ", dst, ":", port, " every ~",
                  F.bround(mean, 0).cast("bigint"), "s"),
        description=cat(src, " connects to ", dst, ":", port, " at regular intervals."),
        action=cat("Find the process on ", src, " behind these connections."),
        rationale=cat("CV ", F.round("cv", 3), " over ", n, " intervals"),
        extra={"mean_interval_seconds": F.round(mean, 2), "cv": F.round("cv", 4),
               "interval_count": n, "min_interval": F.round("shortest", 2),
               "max_interval": F.round("longest", 2)},
        explanation=explain(
            evidence("coefficient_of_variation", F.round("cv", 4), F.lit(cfg.beacon_cv), "<=",
                     "regularity of machine-timed traffic"),
            evidence("intervals_analyzed", n, baseline=cat("mean interval ", F.round(mean, 1), " s")),
            basis="by band of CV, 0.15 less for a known destination"))


def beacon_from_sockets(sockets: DataFrame, cfg: Config = Config(),
                        baseline: DataFrame | None = None) -> DataFrame:
    """The same on socket snapshots: one event per open flow and snapshot."""
    rows = (sockets.where(F.col("state").isin("ESTABLISHED", "SYN_SENT"))
            .groupBy("us", F.col("local_ip").alias("src_ip"), F.col("remote_ip").alias("dst_ip"),
                     F.col("remote_port").alias("dst_port")).agg(F.min("event_id").alias("event_id")))
    return beacon(rows, cfg, baseline)
