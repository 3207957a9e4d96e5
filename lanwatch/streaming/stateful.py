"""Sliding counters, cooldowns and their timers on a stream, exact with respect to event time.

Rows wait until the watermark has passed them and are then evaluated in event-time order, so a
stream gives the same rows as the batch operators, later by the watermark delay.
"""

from __future__ import annotations

import math
import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import SECOND, Config
from ..operators.beacon import FLOW, beacon_alerts, outbound
from ..operators.windows import BUCKETS_PER_WINDOW, with_lookback

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VALUE_BUCKETS = 64  # of the values of one key, in first-seen state

_ROW = "us bigint, event_id bigint, value string"


class _BucketCounter(StatefulProcessor):
    """Distinct values in (us - window, us] for the rows of one (key, time bucket).

    The bucket is evaluated once, when the watermark passes its end, and its state is dropped.
    """

    def __init__(self, window_us: int, key_names: list[str]):
        self.window_us, self.key_names = window_us, key_names
        self.width = window_us * BUCKETS_PER_WINDOW

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROW + ", own boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.rows.appendList([(int(u), int(e), v if isinstance(v, str) else None, bool(o)) for u, e, v, o in zip(
                batch["us"], batch["event_id"], batch["value"], batch["own"])])
        self.handle.registerTimer((int(key[-1]) + 1) * self.width // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(self.rows.get(), key=lambda r: (r[0], r[1]))
        self.rows.clear()
        out, counts, low, i = [], {}, 0, 0
        while i < len(rows):
            now, j = rows[i][0], i
            while j < len(rows) and rows[j][0] == now:
                if rows[j][2] is not None:  # a null is no value
                    counts[rows[j][2]] = counts.get(rows[j][2], 0) + 1
                j += 1
            while rows[low][0] <= now - self.window_us:
                if rows[low][2] is not None:
                    counts[rows[low][2]] -= 1
                    if not counts[rows[low][2]]:
                        del counts[rows[low][2]]
                low += 1
            out += [(*key[:-1], r[0], r[1], r[2], len(counts)) for r in rows[i:j] if r[3]]
            i = j
        if out:
            yield pd.DataFrame(out, columns=[*self.key_names, "us", "event_id", "value", "n_distinct"])

    def close(self) -> None:
        pass


def sliding_distinct_stream(events: DataFrame, keys: list[str], value: str, window_us: int) -> DataFrame:
    """Streaming `sliding_distinct`: `events` has `ts` (with a watermark), `us`, `event_id`.

    State is kept per (key, time bucket), so a busy key is spread over tasks here too.
    """
    rows = with_lookback(events.select("ts", "us", "event_id", *keys, F.col(value).cast("string").alias("value")),
                         window_us).withColumnsRenamed({"_own": "own", "_bucket": "bucket"})
    fields = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)
    schema = f"{fields}, us bigint, event_id bigint, value string, n_distinct bigint"
    return rows.groupBy(*keys, "bucket").transformWithStateInPandas(
        statefulProcessor=_BucketCounter(window_us, keys), outputStructType=schema,
        outputMode="append", timeMode="eventTime")


class _Cooldown(StatefulProcessor):
    """Greedy cooldown of one key. The last kept time is dropped by a timer when its cooldown is over."""

    def __init__(self, quiet_us: int, columns: list[str]):
        self.quiet_us, self.columns = quiet_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            pairs = [(int(u), int(e)) for u, e in zip(batch["us"], batch["event_id"])]
            self.waiting.appendList(pairs)
            first = min(pairs)[0] if first is None else min(first, min(pairs)[0])
        if first is not None:  # one timer: when it expires, all rows due by then are settled
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = sorted(self.waiting.get())
        due, rest = [r for r in rows if r[0] < limit], [r for r in rows if r[0] >= limit]
        if not due:  # settled with an earlier timer of this batch, or the cooldown is over
            if self.last.exists() and self.last.get()[0] + self.quiet_us < limit:
                self.last.clear()
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for us, event_id in due:
            if last is None or us - last >= self.quiet_us:
                last = us
                kept.append((*key, us, event_id))
        if kept:
            self.last.update((last,))
            self.handle.registerTimer((last + self.quiet_us) // 1000 + 2)
            yield pd.DataFrame(kept, columns=self.columns)

    def close(self) -> None:
        pass


def cooldown_stream(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Streaming `cooldown`: kept rows as (keys, us, event_id)."""
    fields = ", ".join(f"{k} {t}" for k, t in events.select(*keys).dtypes)
    return events.select("ts", *keys, "us", "event_id").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Cooldown(seconds * SECOND, [*keys, "us", "event_id"]),
        outputStructType=f"{fields}, us bigint, event_id bigint", outputMode="append",
        timeMode="eventTime")


class _Beacon(StatefulProcessor):
    """Gap statistics of one flow, row by row in event-time order.

    Kept are the gaps in the frame of `history` events (null for a gap that does not count), or, with `history`
    None, only their number, sums and extremes. A timer drops the flow once it was idle, and once its cooldown is over.
    """

    def __init__(self, history: int | None, idle_us: int, quiet_us: int, min_gap: float, intervals: int, min_mean: float, cv: float,
                 columns: list[str]):
        self.history, self.idle_us, self.quiet_us, self.min_gap = history, idle_us, quiet_us, min_gap
        self.intervals, self.min_mean, self.cv, self.columns = intervals, min_mean, cv, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint")
        self.flow = handle.getValueState("flow", "last bigint, n bigint, total double, squares double, low double, high double")
        self.gaps = handle.getListState("gaps", "gap double")
        self.kept = handle.getValueState("kept", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            pairs = [(int(u), int(e)) for u, e in zip(batch["us"], batch["event_id"])]
            self.waiting.appendList(pairs)
            first = min(pairs)[0] if first is None else min(first, min(pairs)[0])
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = sorted(self.waiting.get())
        due, rest = [r for r in rows if r[0] < limit], [r for r in rows if r[0] >= limit]
        if not due:
            if not rest:  # nothing came meanwhile
                if self.flow.exists() and self.flow.get()[0] + self.idle_us < limit:
                    self.flow.clear()
                    self.gaps.clear()
                if self.kept.exists() and self.kept.get()[0] + self.quiet_us < limit:
                    self.kept.clear()
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        last, n, total, squares, low, high = self.flow.get() if self.flow.exists() else (None, 0, 0.0, 0.0, None, None)
        frame = deque((g[0] for g in self.gaps.get()), maxlen=self.history - 1) if self.history else None
        kept = self.kept.get()[0] if self.kept.exists() else None
        fired = []
        for us, event_id in due:
            gap = None if last is None else (us - last) / SECOND
            if gap is not None and us - last > self.idle_us:  # starts anew
                gap, n, total, squares, low, high = None, 0, 0.0, 0.0, None, None
                if frame is not None:
                    frame.clear()
            last, good = us, gap if gap is not None and gap >= self.min_gap else None
            if frame is not None:
                frame.append(good)
                values = [g for g in frame if g is not None]
                n = len(values)
                mean = sum(values) / n if n else 0.0
                spread = math.sqrt(sum((g - mean) ** 2 for g in values) / n) if n else 0.0
                low, high = (min(values), max(values)) if n else (None, None)
            else:
                if good is not None:
                    n, total, squares = n + 1, total + good, squares + good * good
                    low, high = (good, good) if low is None else (min(low, good), max(high, good))
                mean = total / n if n else 0.0
                spread = math.sqrt(max(0.0, squares / n - mean * mean)) if n else 0.0
            if n >= max(1, self.intervals) and mean >= self.min_mean and mean > 0 and spread / mean <= self.cv:
                if kept is None or us - kept >= self.quiet_us:
                    kept = us
                    fired.append((*key, us, event_id, n, mean, spread, low, high, spread / mean))
        self.flow.update((last, n, total, squares, low, high))
        if frame is not None:
            self.gaps.put([(g,) for g in frame])
        self.handle.registerTimer((last + self.idle_us) // 1000 + 2)
        if kept is not None:
            self.kept.update((kept,))
            self.handle.registerTimer((kept + self.quiet_us) // 1000 + 2)
        if fired:
            yield pd.DataFrame(fired, columns=self.columns)

    def close(self) -> None:
        pass


def beacon_stream(conn: DataFrame, cfg: Config = Config(), baseline: DataFrame | None = None) -> DataFrame:
    """Streaming `beacon`: the alerts of the batch operator, in append mode, late by the watermark's delay."""
    names = [*FLOW, "us", "event_id", "intervals", "mean", "sd", "shortest", "longest", "cv"]
    rows = outbound(conn, cfg).select("ts", *FLOW, "us", "event_id")
    fields = ", ".join(f"{k} {t}" for k, t in rows.select(*FLOW).dtypes)
    fired = rows.groupBy(*FLOW).transformWithStateInPandas(
        statefulProcessor=_Beacon(cfg.beacon_history, cfg.beacon_idle * SECOND, cfg.beacon_cooldown * SECOND, cfg.beacon_min_gap,
                                  cfg.beacon_intervals, cfg.beacon_min_mean, cfg.beacon_cv, names),
        outputStructType=f"{fields}, us bigint, event_id bigint, intervals bigint, mean double, sd double, shortest double, longest double, cv double",
        outputMode="append", timeMode="eventTime")
    return beacon_alerts(fired, cfg, baseline)


class _FirstSeen(StatefulProcessor):
    """Values met by one (key, bucket of values); the earliest row of a new one is passed on when the watermark is past it.

    `keep_us`: a value not met for so long counts as new again, and its entry is dropped by a timer.
    """

    def __init__(self, keep_us: int | None, columns: list[str]):
        self.keep_us, self.columns = keep_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "value string", "us bigint")
        self.waiting = handle.getMapState("waiting", "value string", "first bigint, event_id bigint, last bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for value, us in zip(initialState["value"], initialState["us"]):
            self._know(value, int(us) if us == us and us is not None else now)

    def _know(self, value: str, us: int) -> None:
        if self.known.containsKey((value,)):
            us = max(us, self.known.getValue((value,))[0])
        self.known.updateValue((value,), (us,))
        if self.keep_us is not None:
            self.handle.registerTimer((us + self.keep_us) // 1000 + 2)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for value, us, event_id in zip(batch["value"], batch["us"], batch["event_id"]):
                us, event_id = int(us), int(event_id)
                if self.keep_us is None and self.known.containsKey((value,)):
                    continue
                mine = (us, event_id, us)
                if self.waiting.containsKey((value,)):
                    old = self.waiting.getValue((value,))
                    mine = (*min((us, event_id), tuple(old[:2])), max(us, old[2]))
                self.waiting.updateValue((value,), mine)
                first = us if first is None else min(first, us)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        out, later = [], []
        for (value,), (us, event_id, last) in list(self.waiting.iterator()):
            if us >= limit:
                later.append(us)
                continue
            known = self.known.getValue((value,))[0] if self.known.containsKey((value,)) else None
            if known is None or (self.keep_us is not None and us - known > self.keep_us):
                out.append((*key[:-1], value, us, event_id))
            self._know(value, last)
            self.waiting.removeKey((value,))
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        if self.keep_us is not None:
            for (value,), (us,) in list(self.known.iterator()):
                if us + self.keep_us < limit:
                    self.known.removeKey((value,))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def first_seen_stream(events: DataFrame, keys: list[str], value: str, baseline: DataFrame | None = None,
                      keep_seconds: int | None = None) -> DataFrame:
    """Streaming `first_seen`: (keys, value as text, us, event_id) of the first row of each (keys, value).

    What `baseline` (keys, value, and `us` where known) holds is known from the start: it seeds the state of the
    first run, later ones go on from the checkpoint. A null value is no value. State is kept per key and one of
    VALUE_BUCKETS hashes of the value, so a busy key is spread over tasks.
    """
    def bucket(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(VALUE_BUCKETS)))

    rows = bucket(events.select("ts", *keys, F.col(value).cast("string").alias("value"), "us", "event_id").where("value is not null"))
    fields = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)
    seed = None
    if baseline is not None:
        us = F.col("us").cast("long") if "us" in baseline.columns else F.lit(None).cast("long")
        seed = bucket(baseline.select(*keys, F.col(value).cast("string").alias("value"), us.alias("us")).where("value is not null")).groupBy(*keys, "bucket")
    found = rows.groupBy(*keys, "bucket").transformWithStateInPandas(
        statefulProcessor=_FirstSeen(None if keep_seconds is None else keep_seconds * SECOND, [*keys, "value", "us", "event_id"]),
        outputStructType=f"{fields}, value string, us bigint, event_id bigint", outputMode="append", timeMode="eventTime", initialState=seed)
    return found.withColumnRenamed("value", value)
