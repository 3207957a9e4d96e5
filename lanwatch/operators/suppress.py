"""Order-dependent suppression: greedy cooldowns and adaptive thresholds.

Whether a row is kept depends on the last row kept before it, so a key's rows form a chain. Folding a whole
key in one task would not survive a busy key. What a stretch of rows does to "time of the last kept row" is a
step function, and step functions compose. `cooldown` cuts every key into time blocks, reads each block
backwards to find its function, walks the functions of a key (one short row per block), and picks rows in all
blocks in parallel. Every pass is a sorted stream that holds the rows of one cooldown at most.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import SECOND, Adaptive

# Python workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_COOLDOWNS = 4  # block length in cooldowns; a busy key is spread over as many tasks as it has blocks
_NEVER = -(2 ** 62)
_GROUP = ["_g1", "_g2"]


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values in all columns."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    change[:1] = True
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], len(change))


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, latest row first -> their step functions: an incoming time L <= upto[i] (first such i) leaves as
    last[i], a later one unchanged.

    Row i takes L <= ts - quiet and passes on what the rows after it make of its own time. Steps above the
    row's time are out of reach for all earlier rows, but for the first, so they are dropped on the way.
    """
    current, steps = None, deque()  # (upto, last), the greatest first

    def row():
        return (*current, [u for u, _ in reversed(steps)], [v for _, v in reversed(steps)])

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:3]), *(pa.array(c, pa.list_(pa.int64())) for c in list(zip(*rows))[3:])],
            ["_g1", "_g2", "_blk", "upto", "last"])

    for batch in batches:
        g1, g2, blk, ts, quiet = _numbers(batch, "_g1", "_g2", "_blk", "_ts", "_quiet")
        out = []
        for a, b in zip(*_groups(g1, g2, blk)):
            key = (int(g1[a]), int(g2[a]), int(blk[a]))
            if key != current:
                if current:
                    out.append(row())
                current, steps = key, deque()
            for t, reach in zip(ts[a:b].tolist(), (ts[a:b] - quiet[a:b]).tolist()):
                while len(steps) > 1 and steps[1][0] >= t:
                    steps.popleft()
                value = steps[0][1] if steps and steps[0][0] >= t else t
                while steps and steps[-1][0] <= reach:
                    steps.pop()
                if not steps or steps[-1][1] != value:
                    steps.append((reach, value))
        if out:
            yield table(out)
    if current:
        yield table([row()])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step functions of a key in time order -> the time of the last kept row on entry to each block."""
    current, last = None, _NEVER
    for batch in batches:
        g1, g2, blk = _numbers(batch, "_g1", "_g2", "_blk")
        entries = np.empty(len(g1), np.int64)
        for i, (key, upto, out) in enumerate(zip(zip(g1.tolist(), g2.tolist()), batch.column("upto"), batch.column("last"))):
            if key != current:
                current, last = key, _NEVER
            entries[i] = last
            at = int(np.searchsorted(upto.values.to_numpy(), last, "left"))
            if at < len(upto):
                last = out[at].as_py()
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (g1, g2, blk)), pa.array(entries)], ["_g1", "_g2", "_blk", "_entry"])


def _pick(strict: bool, columns: list[str]):
    """Blocks in time order, each after a row that holds its entry -> the kept rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _NEVER
        for batch in batches:
            g1, g2, blk, ts, quiet, entry = _numbers(batch, "_g1", "_g2", "_blk", "_ts", "_quiet", "_entry")
            head = batch.column("_head").to_numpy(zero_copy_only=False)
            kept = []
            for a, b in zip(*_groups(g1, g2, blk)):
                if head[a]:
                    last, a = int(entry[a]), a + 1
                t, reach = ts[a:b], ts[a:b] - quiet[a:b]
                top = np.maximum.accumulate(reach)
                i = int(np.searchsorted(top, last, "left"))
                while i < len(t):
                    if not strict or reach[i] > last:
                        kept.append(a + i)
                    last, before = int(t[i]), i
                    i = int(np.searchsorted(top, last, "left"))
                    if i <= before:  # a cooldown of nothing
                        i = before + 1
                        while i < len(t) and reach[i] < last:
                            i += 1
            if kept:
                row = batch.column("_row").take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([row.field(i) for i in range(len(columns))], columns)

    return run


def cooldown(df: DataFrame, keys: str | list[str], seconds: int | Column, *, ts: str = "us",
             tie: str = "event_id", strict: bool = False, longest: int | None = None) -> DataFrame:
    """Keep a row only if `seconds` have passed since the last kept row of its key.

    `seconds` may be a column (per-row cooldown); `longest` is then its upper bound. With `strict` the wait
    must be longer than the cooldown; a row exactly at the limit is dropped but restarts the wait. Rows at one
    time are taken by `tie`; of identical rows one is kept. Rows without a time are dropped. A cooldown of 0
    keeps every row, which also works on a stream. Building the result starts no job.
    """
    if isinstance(seconds, int) and seconds == 0:
        return df
    keys = [keys] if isinstance(keys, str) else keys
    longest = seconds if longest is None else longest
    quiet = seconds * SECOND if isinstance(seconds, Column) else F.lit(int(seconds * SECOND))
    width = longest * SECOND * BLOCK_COOLDOWNS
    parts = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]  # a hash alone passes over nulls
    rows = df.where(F.col(ts).isNotNull()).select(
        F.xxhash64(*parts).alias("_g1"), F.xxhash64(F.lit(1), *parts).alias("_g2"),
        F.floor(F.col(ts) / width).cast("bigint").alias("_blk"), F.col(ts).cast("bigint").alias("_ts"), F.col(tie).alias("_tie"),
        quiet.cast("bigint").alias("_quiet"), F.struct(*df.columns).alias("_row"))
    block = [*_GROUP, "_blk"]
    backwards = rows.select(*block, "_ts", "_tie", "_quiet").repartition(*block).sortWithinPartitions(
        *block, F.desc("_ts"), F.desc("_tie"), F.desc("_quiet"))
    steps = backwards.mapInArrow(_summarise, "_g1 long, _g2 long, _blk long, upto array<long>, last array<long>")
    entries = steps.repartition(*_GROUP).sortWithinPartitions(*block).mapInArrow(_walk, "_g1 long, _g2 long, _blk long, _entry long")
    both = rows.withColumns({"_head": F.lit(False), "_entry": F.lit(0).cast("long")}).unionByName(
        entries.withColumns({"_head": F.lit(True), "_ts": F.lit(0).cast("long"), "_quiet": F.lit(0).cast("long")}), allowMissingColumns=True)
    ordered = both.repartition(*block).sortWithinPartitions(*block, F.desc("_head"), "_ts", "_tie", "_quiet").drop("_tie")
    return ordered.mapInArrow(_pick(strict, df.columns), df.schema)


def adaptive_cooldown(df: DataFrame, host: str, count: str, base: float, seconds: int,
                      adaptive: Adaptive, *, pair: str | None = None, ts: str = "us", tie: str = "event_id") -> DataFrame:
    """Cooldown whose threshold grows while a host keeps alerting; adds `threshold`.

    `df` holds candidates with `count` >= `base` (the multiplier never falls below 1). The cooldown runs per
    (host, `pair`) where `pair` is given, else per host; trips count per host, and a trip counts up to and
    including the edge of the trip window.

    The state is a list of recent trips and, with `pair`, the recent alerts by pair, so the candidates of a
    host are taken in time order. They are cut at every quiet span longer than the memory, which makes the
    stretches independent; a stretch is one sorted stream, whose state holds one memory of alerts.
    """
    if not adaptive.enabled:
        return (cooldown(df, [host] + ([pair] if pair else []), seconds, ts=ts, tie=tie)
                .withColumn("threshold", F.lit(float(base))))
    memory = max(seconds, adaptive.window) * SECOND
    rows = df.withColumn("_cell", F.floor(F.col(ts) / memory).cast("bigint"))
    order = Window.partitionBy(host).orderBy("_cell")
    gap = F.col("_cell") - F.lag("_cell").over(order) > 1  # a whole empty cell: memory has expired
    runs = (rows.select(host, "_cell").distinct().withColumn("_new", F.when(gap, 1).otherwise(0))
            .withColumn("_run", F.sum("_new").over(order)).select(host, "_cell", "_run"))
    ordered = (rows.join(runs, [host, "_cell"]).drop("_cell").repartition(host, "_run")
               .sortWithinPartitions(host, "_run", ts, tie))
    schema = StructType([*df.schema.fields, StructField("threshold", DoubleType())])
    return ordered.mapInArrow(_adaptive_fold(host, pair, count, base, seconds * SECOND, adaptive, ts, df.columns), schema)


def _adaptive_fold(host, pair, count, base, quiet, adaptive: Adaptive, ts, columns):
    # Plain values, so that the function needs no module of this package on the workers.
    window, free = adaptive.window * SECOND, adaptive.trips_before_backoff
    step, top = adaptive.step, adaptive.max_multiplier

    def multiplier(trips: int) -> float:
        return 1.0 if trips < free else min(top, 1.0 + step * (trips - free + 1))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, trips, full = None, {}, deque(), 1024
        for batch in batches:
            kept, limits = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in (host, "_run", pair or "_run", ts, count)))
            for i, (h, run, p, t, n) in enumerate(rows):
                if (h, run) != current:
                    current, last, trips = (h, run), {}, deque()
                if p in last and t - last[p] < quiet:
                    continue
                while trips and trips[0] < t - window:
                    trips.popleft()
                limit = base * multiplier(len(trips))
                if n < limit:
                    continue
                last[p] = t
                if len(last) > full:  # forget what no longer waits
                    last = {k: v for k, v in last.items() if t - v < quiet}
                    full = max(1024, 2 * len(last))
                trips.append(t)
                kept.append(i)
                limits.append(float(limit))
            if kept:
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in columns), pa.array(limits)], [*columns, "threshold"])

    return fold
