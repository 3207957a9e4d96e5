"""Batches in any order of event time give the alerts and incidents of one batch."""

import random

import pytest
from pyspark.sql import functions as F

from lanwatch.config import Config
from lanwatch.functions.alerting import to_alerts
from lanwatch.plans import alerts as plans
from lanwatch.streaming import late

from .conftest import S, T0

SHAPE = "event_id long, us long, src string, dst string, kind string, severity string"


def detect(df):
    """Scans and honeypot hits of hosts; severities, and so the cooldowns of a key, differ from row to row."""
    def part(kind, affected, related):
        return to_alerts(df.where(F.col("kind") == kind), category=kind, severity=F.col("severity"), confidence=0.9, affected=F.col(affected),
                         related=F.col(related), dedup_key=F.concat(F.lit(kind + ":"), "src", F.lit(":"), "dst"), title=F.lit("t"),
                         extra={"n": F.col("event_id")}, sensor=F.concat(F.lit("s"), F.col("event_id") % 2))
    return part("port_scan", "dst", "src").unionByName(part("honeypot", "src", "dst"))


def view(df):
    return sorted((r.alert_id, r.us, r.category, r.severity, r.affected_host, r.extra, r.title, r.description) for r in df.collect())


def events(seed, n=260):
    """Times in steps of a minute, so that many rows lie exactly at the end of a cooldown; every (key, time) once."""
    rng, rows = random.Random(seed), {}
    for i in range(n):
        src, dst, kind = f"10.0.0.{rng.randrange(2)}", f"10.0.1.{rng.randrange(7)}", rng.choice(["port_scan", "honeypot"])
        t = T0 + rng.randrange(0, 160) * 60 * S + (26 * 3600 * S if rng.random() < 0.3 else 0)
        rows[(src, dst, kind, t)] = (i, t, src, dst, kind, rng.choice(["high", "critical"]))
    return list(rows.values())


@pytest.mark.parametrize("order", ["backwards", "shuffled"])
def test_any_order_gives_the_rows_of_one_batch(spark, tmp_path, order):
    rows, cfg, path = events(5), Config(), str(tmp_path / "late")
    data = spark.createDataFrame(rows, SHAPE)
    mutes = spark.createDataFrame([("port_scan:10.0.0.0:10.0.1.1", T0 + 3600 * S)], "dedup_key string, us long")
    want = view(plans.process(detect(data), cfg, mutes=mutes))
    assert sum(w[2] == "incident" for w in want) >= 4
    dealt = sorted(rows, key=lambda r: -r[1]) if order == "backwards" else random.Random(1).sample(rows, len(rows))
    parts = [dealt[:110], dealt[110:111], [], dealt[111:]]
    step = late.late_alert_batches(detect, path, cfg, mutes=mutes)
    receiver = {}
    for i, part in enumerate(parts):
        step(spark.createDataFrame(part, SHAPE), i)
        if i == 1:
            step(spark.createDataFrame(part, SHAPE), i)  # tried again
        for r in late.batch_changes(spark, path, i).orderBy(F.desc("withdrawn")).collect():
            receiver.pop(r.alert_id, None) if r.withdrawn else receiver.__setitem__(r.alert_id, r)
    assert view(late.alerts_in_force(spark, path)) == want
    assert sorted(receiver) == [w[0] for w in want] and all(receiver[w[0]].extra == w[5] for w in want)
    assert late.Versions(f"{path}/alerts").changes(spark).where("gone").count() > 0


def test_rows_at_the_limit_ties_and_nulls(spark, tmp_path):
    path = str(tmp_path / "late")
    cols = "dedup_key string, us long, severity string, title string"

    def raw(df):
        made = to_alerts(df.withColumn("k", F.col("dedup_key")), category="honeypot", severity=F.col("severity"), confidence=0.5,
                         affected="h", title=F.col("title"), dedup_key=F.col("k"))
        return made.unionByName(made)  # repeated rows

    step = late.late_alert_batches(raw, path, correlate=False)
    step(spark.createDataFrame([("a", T0, "high", "x"), (None, T0, "high", "x"), ("a", None, "high", "x")], cols), 0)
    step(spark.createDataFrame([("a", T0 + 300 * S, "high", "x")], cols), 1)  # at the limit: no alert, but the wait starts anew
    step(spark.createDataFrame([("a", T0 + 301 * S, "high", "x"), ("b", T0, "high", "y"), ("b", T0, "critical", "z"), ("b", T0, "high", "w")], cols), 2)
    step(spark.createDataFrame([], cols), 3)
    got = {(r.dedup_key, r.us - T0, r.title) for r in late.alerts_in_force(spark, path).collect()}
    assert got == {("a", 0, "x"), (None, 0, "x"), ("b", 0, "z")}
    step(spark.createDataFrame([("a", T0 - 10 * S, "high", "late")], cols), 4)  # pushes the first one out, and the rest follows
    got = {(r.dedup_key, (r.us - T0) // S, r.title) for r in late.alerts_in_force(spark, path).collect()}
    assert got == {("a", -10, "late"), ("a", 300, "x"), (None, 0, "x"), ("b", 0, "z")}


def test_nothing_yet(spark, tmp_path):
    assert late.alerts_in_force(spark, str(tmp_path / "none")).count() == 0


def test_late_alerts_order_slim_rows_and_fetch_the_rest(spark):
    raw = detect(spark.createDataFrame(events(9, 60), SHAPE))
    other = raw.withColumn("title", F.lit("a"))  # the same alerts again, with a lesser title
    none = raw.limit(1).withColumn("dedup_key", F.lit(None).cast("string"))
    history = raw.limit(0)
    got = late.judged(raw.unionByName(other).unionByName(none), Config(), None, history)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan  # what is kept is a table, and only that meets whole rows
    rows = got.collect()
    assert len(rows) == len({(r.alert_id, r.dedup_key) for r in rows}) and sum(r.dedup_key is None for r in rows) == 1
    assert {r.title for r in rows if r.dedup_key is not None} == {"a"}
    want = late.judged(other, Config(), None, history).collect()
    assert sorted(map(str, want)) == sorted(str(r) for r in rows if r.dedup_key is not None)
