import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lanwatch.config import Adaptive
from lanwatch.operators.firsts import first_seen
from lanwatch.operators.lineage import cut
from lanwatch.operators.suppress import adaptive_cooldown, cooldown
from lanwatch.operators.windows import previous_value, running_total, sliding_count, sliding_distinct

from .conftest import S


def events(seed, n=600, span=4000, keys="aaaaab"):
    """Random events; key a holds most of them, and some share their time."""
    r = random.Random(seed)
    return [(i, r.choice(keys), r.choice("uvwxyz"), r.randrange(span) * S + r.choice([0, 0, r.randrange(S)]))
            for i in range(n)]


SCHEMA = "event_id long, k string, v string, us long"


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_counts_match_brute_force(spark, seed):
    data, w = events(seed), 37 * S
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.event_id: (r.n_distinct, r.n) for r in sliding_distinct(df, ["k"], "v", w, count_out="n").collect()}
    plain = {r.event_id: r.n for r in sliding_count(df, [], w).collect()}
    for i, k, v, us in data:
        near = [x for x in data if us - w < x[3] <= us]
        mine = [x for x in near if x[1] == k]
        assert got[i] == (len({x[2] for x in mine}), len(mine))
        assert plain[i] == len(near)


def test_null_values_count_for_nothing(spark):
    df = spark.createDataFrame([(1, "a", None, 0), (2, "a", "x", 1), (3, "a", None, 2)], SCHEMA)
    assert {r.event_id: r.d for r in sliding_distinct(df, ["k"], "v", 10, "d").collect()} == {1: 0, 2: 1, 3: 1}


def test_window_is_half_open(spark):
    df = spark.createDataFrame([(1, "a", "x", 0), (2, "a", "y", 10 * S - 1), (3, "a", "z", 10 * S)], SCHEMA)
    assert {r.event_id: r.n for r in sliding_count(df, ["k"], 10 * S).collect()} == {1: 1, 2: 2, 3: 2}


def greedy(data, quiet):
    kept, last = set(), {}
    for i, k, _, us in sorted(data, key=lambda x: (x[3], x[0])):
        if k not in last or us - last[k] >= quiet:
            last[k] = us
            kept.add(i)
    return kept


@pytest.mark.parametrize("seed,seconds", [(1, 1), (2, 13), (3, 60), (4, 5000)])
def test_cooldown_matches_replay(spark, seed, seconds):
    data = events(seed, 900)
    got = [r.event_id for r in cooldown(spark.createDataFrame(data, SCHEMA), "k", seconds).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(data, seconds * S)


def test_cooldown_of_a_dense_key_crosses_many_blocks(spark):
    data = [(i, "a", "x", i * S // 7) for i in range(20_000)]
    got = {r.event_id for r in cooldown(spark.createDataFrame(data, SCHEMA), "k", 10).collect()}
    assert got == greedy(data, 10 * S)


def test_cooldown_keeps_one_of_identical_rows(spark):
    data = [(1, "a", 0), (1, "a", 0), (2, "a", 5 * S), (3, "a", 20 * S), (3, "a", 20 * S), (4, None, 0), (4, None, 0)]
    df = spark.createDataFrame(data, "event_id long, k string, us long")
    assert sorted(r.event_id for r in cooldown(df, "k", 10).collect()) == [1, 3, 4]


def test_cooldown_of_a_million_rows_in_few_blocks(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("event_id"), F.lit("a").alias("k"), (F.col("id") * 37).alias("us"))
    last, want = None, []
    for i in range(1_000_000):
        if last is None or i * 37 - last >= 2 * S:
            last = i * 37
            want.append(i)
    started = spark.sparkContext.statusTracker().getJobIdsForGroup()
    got = cooldown(df, "k", 2)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == started  # building it starts no job
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert sorted(r.event_id for r in got.collect()) == want


def test_adaptive_cooldown_forgets_pairs(spark):
    df = spark.range(60_000).select(F.col("id").alias("event_id"), F.lit("h").alias("h"), F.col("id").cast("string").alias("p"),
                                    (F.col("id") * S).alias("us"), F.lit(1000).alias("n"))
    twice = df.unionByName(df)
    assert adaptive_cooldown(twice, "h", "n", 1, 15, Adaptive(trips_before_backoff=3, window=20), pair="p").count() == 60_000


def test_cooldown_ignores_input_order(spark):
    data = events(5)
    df = spark.createDataFrame(data, SCHEMA)
    a = {r.event_id for r in cooldown(df, "k", 30).collect()}
    b = {r.event_id for r in cooldown(df.orderBy(F.rand(3)).repartition(7), "k", 30).collect()}
    assert a == b


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cooldown_per_row_and_strict(spark, seed):
    r = random.Random(seed)
    data = [(i, r.choice("ab"), r.randrange(3000) * S, r.choice([20, 60, 120])) for i in range(500)]
    df = spark.createDataFrame(data, "event_id long, k string, us long, q int")
    got = {x.event_id for x in cooldown(df, "k", F.col("q"), strict=True, longest=120).collect()}
    kept, last = set(), {}
    for i, k, us, q in sorted(data, key=lambda x: (x[2], x[0])):
        if k not in last or us - last[k] > q * S:
            kept.add(i)
            last[k] = us
        elif us - last[k] == q * S:
            last[k] = us
    assert got == kept


@pytest.mark.parametrize("seed,paired,span", [(1, False, 6000), (2, False, 300), (3, True, 6000)])
def test_adaptive_cooldown_matches_replay(spark, seed, paired, span):
    r = random.Random(seed)
    a = Adaptive(trips_before_backoff=3, window=200)
    data = [(i, r.choice("aaab"), r.choice("xy"), r.randrange(span) * S, r.randrange(10, 60)) for i in range(900)]
    df = spark.createDataFrame(data, "event_id long, h string, p string, us long, n int")
    got = {x.event_id: x.threshold for x in adaptive_cooldown(df, "h", "n", 10, 15, a, pair="p" if paired else None).collect()}
    want, last, trips = {}, {}, {}
    for i, h, p, us, n in sorted(data, key=lambda x: (x[3], x[0])):
        key = (h, p if paired else 0)
        if key in last and us - last[key] < 15 * S:
            continue
        recent = [t for t in trips.get(h, []) if t >= us - 200 * S]
        m = 1.0 if len(recent) < 3 else min(4.0, 1 + 0.5 * (len(recent) - 2))
        if n >= 10 * m:
            last[key] = us
            trips[h] = recent + [us]
            want[i] = 10 * m
    assert got == want and max(want.values()) > 10


def test_previous_value_and_running_total(spark):
    data = [(i, k, v if i % 3 else None, us) for i, k, v, us in events(7, 400)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("amount", F.lit(2))
    prev = {r.event_id: r.p for r in previous_value(df, "k", "v", "p", bucket_s=50).collect()}
    total = {r.event_id: r.t for r in running_total(df, "k", "amount", "t", bucket_s=50).collect()}
    seen, sums = {}, {}
    for i, k, v, us in sorted(data, key=lambda x: (x[3], x[0])):
        assert prev[i] == seen.get(k)
        if v is not None:
            seen[k] = v
        sums[k] = sums.get(k, 0) + 2
        assert total[i] == sums[k]


def test_first_seen_counts_what_was_known(spark):
    data = [(1, "a", "x", 1), (2, "a", "y", 2), (3, "a", "x", 3), (4, "a", "z", 4), (5, "b", "x", 5)]
    base = spark.createDataFrame([("a", "q"), ("a", "y")], "k string, v string")
    got = {(r.k, r.v): (r.event_id, r.known) for r in first_seen(spark.createDataFrame(data, SCHEMA), ["k"], "v", base).collect()}
    assert got == {("a", "x"): (1, 2), ("a", "z"): (4, 3), ("b", "x"): (5, 0)}


def test_cut_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffles():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {n for d in manager.localDirs() for _, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle_")}

    before, had = shuffles(), spark.conf.get(setting, None)
    table = cut(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(100):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert sorted(r["count"] for r in table.collect()) == [100] * 10 and spark.conf.get(setting, None) == had
