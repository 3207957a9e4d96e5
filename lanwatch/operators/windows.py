"""Sliding-window primitives that stay balanced when one key holds most of the rows.

A window partitioned by the key alone would send every row of a busy key to one task. Here the
partition is (key, time bucket): a busy key is cut along time, and the last window of each bucket
is copied into the next one, so each bucket can be computed on its own and exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SECOND

BUCKETS_PER_WINDOW = 4  # bucket length in windows; 1/4 of the rows are copied


def with_lookback(df: DataFrame, window_us: int, ts: str = "us",
                  factor: int = BUCKETS_PER_WINDOW) -> DataFrame:
    """Add `_bucket` and `_own`; rows in the last window of a bucket also appear in the next."""
    width = window_us * factor
    bucket = F.floor(F.col(ts) / width).cast("bigint")
    late = F.pmod(F.col(ts), F.lit(width)) >= width - window_us
    places = F.when(late, F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")),
                                  F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))
                    ).otherwise(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own"))))
    return (df.withColumn("_place", F.explode(places))
            .withColumn("_bucket", F.col("_place.b")).withColumn("_own", F.col("_place.own"))
            .drop("_place"))


def _running_cover(df: DataFrame, keys: list[str], ts: str, ends: list[tuple[str, Column]],
                   outs: list[str]) -> DataFrame:
    """For each own row, how many intervals [ts, end) contain its ts, per named end column."""
    starts = F.struct(F.col(ts).alias("t"), F.lit(True).alias("start"),
                      *[F.lit(1).alias(n) for n, _ in ends])
    stops = [F.struct(e.alias("t"), F.lit(False).alias("start"),
                      *[F.lit(-1 if m == n else 0).alias(m) for m, _ in ends]) for n, e in ends]
    w = (Window.partitionBy(*keys, "_bucket").orderBy("_t")
         .rangeBetween(Window.unboundedPreceding, 0))
    marks = (df.withColumn("_mark", F.explode(F.array(starts, *stops)))
             .withColumn("_t", F.col("_mark.t")))
    for (name, _), out in zip(ends, outs):
        marks = marks.withColumn(out, F.sum(F.col(f"_mark.{name}")).over(w).cast("bigint"))
    return (marks.filter(F.col("_mark.start") & F.col("_own"))
            .drop("_mark", "_t", "_bucket", "_own", *[c for c in df.columns if c.startswith("_nxt")]))


def sliding_count(df: DataFrame, keys: list[str], window_us: int, out: str = "n",
                  ts: str = "us") -> DataFrame:
    """Rows of the same key in (ts - window, ts], per row. Cost O(n log n), not O(n * window)."""
    wide = with_lookback(df, window_us, ts).repartition(*keys, "_bucket")
    return _running_cover(wide, keys, ts, [("n", F.col(ts) + window_us)], [out])


def sliding_distinct(df: DataFrame, keys: list[str], values, window_us: int, out="n_distinct",
                     ts: str = "us", count_out: str | None = None) -> DataFrame:
    """Exact number of distinct values of the key in (ts - window, ts], per row.

    An occurrence counts until the value comes again or leaves the window, whichever is first.
    `values` / `out` may be lists: several distinct counts then share one shuffle. A null value
    counts for nothing. `count_out` adds the plain row count.
    """
    values = [values] if isinstance(values, str) else values
    outs = [out] if isinstance(out, str) else list(out)
    wide = with_lookback(df, window_us, ts).repartition(*keys, "_bucket")
    ends = []
    for i, v in enumerate(values):
        again = Window.partitionBy(*keys, "_bucket", v).orderBy(ts)
        wide = wide.withColumn(f"_nxt{i}", F.when(F.col(v).isNotNull(), F.least(
            F.coalesce(F.lead(ts).over(again), F.col(ts) + window_us),
            F.col(ts) + window_us)).otherwise(F.col(ts)))
        ends.append((f"d{i}", F.col(f"_nxt{i}")))
    if count_out:
        ends.append(("n", F.col(ts) + window_us))
        outs.append(count_out)
    return _running_cover(wide, keys, ts, ends, outs)


def window_members(fired: DataFrame, events: DataFrame, keys: list[str], value: Column,
                   window_us: int, out: str) -> DataFrame:
    """Add the sorted distinct values in (us - window, us] to fired rows, which have at least one.

    Equi-join on (key, window-sized bucket): each fired row meets its own and the previous bucket.
    """
    b = F.floor(F.col("us") / window_us).cast("bigint")
    want = fired.withColumn("_b", F.explode(F.array(b, b - 1)))
    have = events.select(*keys, F.col("us").alias("_us"), value.alias("_v"), b.alias("_b"))
    return (want.join(have, [*keys, "_b"])
            .where((F.col("_us") <= F.col("us")) & (F.col("_us") > F.col("us") - window_us))
            .groupBy(*fired.columns).agg(F.sort_array(F.collect_set("_v")).alias(out)))


def previous_value(df: DataFrame, key: str, value: str, out: str, ts: str = "us",
                   tie: str = "event_id", bucket_s: int = 3600) -> DataFrame:
    """Last non-null value on the key's earlier rows (null before it), without one task per key.

    Inside a (key, bucket) it is a plain running last. Earlier buckets contribute one
    pre-aggregated row each.
    """
    b = df.withColumn("_b", F.floor(F.col(ts) / (bucket_s * SECOND)).cast("bigint"))
    at = F.when(F.col(value).isNotNull(), F.struct(ts, tie))
    last = b.groupBy(key, "_b").agg(F.max_by(value, at).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(key, "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    inside = (Window.partitionBy(key, "_b").orderBy(ts, tie)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (b.join(carry, [key, "_b"], "left")
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry"))
            .drop("_b", "_carry"))


def running_total(df: DataFrame, key: str, amount: str, out: str, ts: str = "us",
                  tie: str = "event_id", bucket_s: int = 3600) -> DataFrame:
    """Running sum per key in time order, cut along time: bucket totals first, then inside."""
    b = df.withColumn("_b", F.floor(F.col(ts) / (bucket_s * SECOND)).cast("bigint"))
    totals = b.groupBy(key, "_b").agg(F.sum(amount).alias("_sum"), F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(key, "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_s0"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = (Window.partitionBy(key, "_b").orderBy(ts, tie)
              .rowsBetween(Window.unboundedPreceding, 0))
    return (b.join(carry, [key, "_b"])
            .withColumn(out, F.col("_s0") + F.sum(amount).over(inside))
            .withColumn(f"{out}_rows", (F.col("_n0") + F.count("*").over(inside)).cast("bigint"))
            .drop("_b", "_s0", "_n0"))


def earlier_moments(df: DataFrame, key: str, value: str, ts: str = "us", tie: str = "event_id",
                    bucket_s: int = 86400) -> DataFrame:
    """Add `samples`, `mean` and `sd` (population) of the key's earlier values, cut along time.

    Values are taken relative to the key's overall mean, so that squares stay small. Infinite and NaN values travel
    apart and meet the moments of the finite ones at the end: behind them the mean is infinite or NaN, the deviation
    NaN, and rows before them are as if they were not there.
    """
    x = F.col(value).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    centre = df.groupBy(key).agg(F.coalesce(F.avg(F.when(finite, x)), F.lit(0.0)).alias("_mid"))
    b = (df.join(centre, key).withColumn("_v", F.when(finite, x - F.col("_mid")).when(x.isNotNull(), 0.0))
         .withColumn("_q", F.col("_v") * F.col("_v")).withColumn("_x", F.when(~finite, x).otherwise(0.0))
         .withColumn("_b", F.floor(F.col(ts) / (bucket_s * SECOND)).cast("bigint")))
    sums = b.groupBy(key, "_b").agg(F.count("_v").alias("_n"), *[F.sum(c).alias(f"_s{c}") for c in ("_v", "_q", "_x")])
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(key, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0")
                                     for c in ("_n", "_s_v", "_s_q", "_s_x")])
    inside = (Window.partitionBy(key, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1))
    n = F.col("_n0") + F.count("_v").over(inside)
    s, q, odd = (F.col(f"_s{c}0") + F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for c in ("_v", "_q", "_x"))
    out = b.join(carry, [key, "_b"]).withColumns({"samples": n, "_sum": s, "_squares": q, "_odd": odd})
    mean = F.try_divide("_sum", "samples")
    spread = F.greatest(F.lit(0.0), F.try_divide("_squares", "samples") - mean * mean)
    return (out.withColumn("mean", mean + F.col("_mid") + F.col("_odd"))
            .withColumn("sd", F.coalesce(F.sqrt(spread), F.lit(0.0)) + (F.col("_odd") - F.col("_odd")))
            .drop("_mid", "_v", "_q", "_x", "_b", "_n0", "_s_v0", "_s_q0", "_s_x0", "_sum", "_squares", "_odd"))
