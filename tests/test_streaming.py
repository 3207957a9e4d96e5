import pytest
from pyspark.sql import functions as F

from lanwatch.config import Config
from lanwatch.operators.dns import dns_tunnel_label
from lanwatch.operators.suppress import cooldown
from lanwatch.operators.windows import sliding_distinct
from lanwatch.sources.events import SCHEMAS, canonical, stream_events
from lanwatch.streaming import batches, rules, stateful

from .conftest import S, T0


@pytest.fixture(autouse=True)
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def traffic(spark, path, n=240, parts=3):
    """Connections in time-ordered files, and a last row far ahead that moves the watermark."""
    rows = [(T0 + i * 3 * S + (i % 5), f"192.168.1.{5 + (i % 7 > 4)}", f"192.168.1.{20 + i * i % 11}", [22, 443, 853, 23][i % 4]) for i in range(n)]
    chunks = [rows[k * n // parts:(k + 1) * n // parts] for k in range(parts)] + [[(T0 + 10 ** 6 * S, "0.0.0.0", "0.0.0.0", 1)]]
    for k, chunk in enumerate(chunks):
        df = spark.createDataFrame(chunk, "us long, src_ip string, dst_ip string, dst_port int")
        df.select(F.timestamp_micros("us").alias("ts"), "src_ip", F.lit(1).alias("src_port"), "dst_ip", "dst_port", F.lit("tcp").alias("protocol"),
                  F.lit("S").alias("flags"), F.lit(10).cast("bigint").alias("size"), F.lit("s").alias("sensor")).coalesce(1).write.mode(
                      "append").parquet(path)
        import time
        time.sleep(1.1)  # file order follows modification time
    return canonical(spark.read.schema(SCHEMAS["connections"]).parquet(path))


def run(df, tmp_path, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_stream_forms_match_batch(spark, tmp_path):
    path = str(tmp_path / "conn")
    batch = traffic(spark, path)
    stream = stream_events(spark, "connections", path, maxFilesPerTrigger=1)
    late = T0 + 10 ** 5 * S

    w = 30 * S
    got = run(stateful.sliding_distinct_stream(stream, ["src_ip"], "dst_ip", w), tmp_path, "distinct")
    want = sliding_distinct(batch.select("us", "event_id", "src_ip", "dst_ip"), ["src_ip"], "dst_ip", w, "n")
    assert {(r.event_id, r.n_distinct) for r in got.collect()} == {(r.event_id, r.n) for r in want.collect() if r.us < late}

    got = run(stateful.cooldown_stream(stream, ["src_ip"], 20), tmp_path, "cooled")
    want = cooldown(batch.select("us", "event_id", "src_ip"), "src_ip", 20)
    assert {r.event_id for r in got.collect()} == {r.event_id for r in want.collect() if r.us < late}

    got = run(rules.connection_rules(stream, Config(canary_ports=(23,))), tmp_path, "rules")
    assert got.count() == batch.where("us < %d and dst_port = 23" % late).count()

    got = run(rules.connection_counts(stream), tmp_path, "counts")
    want = batch.groupBy("src_ip", F.floor(F.col("us") / 60_000_000).alias("m")).count()
    assert sorted((r.src_ip, r.us // 60_000_000, r.n) for r in got.collect()) == sorted(
        (r.src_ip, r.m, r["count"]) for r in want.collect() if r.src_ip != "0.0.0.0")

    sessions = run(rules.flow_sessions(stream, "60 seconds"), tmp_path, "sessions").collect()
    assert sum(r.events for r in sessions) == 240
    twice = stream.unionByName(stream)
    assert run(rules.without_duplicates(twice, ["event_id"]), tmp_path, "once").count() == 241


def test_dns_rules_keep_every_row(spark):
    d = spark.createDataFrame([(i, T0 + i, "h", "a" * 60 + ".x.com", "TXT") for i in range(3)],
                              "event_id long, us long, src_ip string, query_name string, query_type string")
    assert rules.dns_rules(d).count() == 3 and dns_tunnel_label(d).count() == 1


def test_alert_batches_survive_a_retry(spark, tmp_path):
    path, out, base = str(tmp_path / "conn"), str(tmp_path / "alerts"), str(tmp_path / "seen")
    traffic(spark, path, n=60)
    stream = stream_events(spark, "connections", path, maxFilesPerTrigger=1)
    cfg = Config(canary_ports=(23,))
    step = batches.alert_batches(lambda b: rules.connection_rules(b, cfg), out, cfg)
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    first = spark.read.parquet(out).count()
    batch = canonical(spark.read.schema(SCHEMAS["connections"]).parquet(path))
    from lanwatch.plans import alerts as plans
    want = plans.process(rules.connection_rules(batch, cfg), cfg)
    assert first == want.count() > 0
    last = spark.read.parquet(out).selectExpr("max(batch_id) m").first().m
    files = sorted(batch.select("_metadata.file_modification_time").distinct().collect())
    again = batch.where(F.col("_metadata.file_modification_time") == files[last][0]) if last < len(files) else batch.limit(0)
    step(again.select(*batch.columns), last)
    assert spark.read.parquet(out).count() == first

    seen = batches.first_seen_batches(["src_ip", "dst_ip"], base, str(tmp_path / "fresh"))
    q = stream.writeStream.foreachBatch(seen).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == batch.select("src_ip", "dst_ip").distinct().count()

    batches.report_batches(str(tmp_path / "report"), lambda: T0 + 3600 * S)(spark.read.parquet(out), 0)
    assert batches.last_report(spark, str(tmp_path / "report")).where("report = 'severity'").count() > 0


def test_incidents_span_batches(spark, tmp_path):
    from lanwatch.functions.alerting import to_alerts
    from lanwatch.plans import alerts as plans
    rows = [(i, T0 + i * 10 * S, "192.168.1.9", f"192.168.1.{40 + i}") for i in range(8)] + [
        (20 + i, T0 + 7200 * S + i * 20 * S, "192.168.1.9", f"192.168.1.{80 + i}") for i in range(7)]
    data = spark.createDataFrame(rows, "event_id long, us long, src string, dst string").withColumn("sensor", F.lit("s1"))

    def detect(df):
        return to_alerts(df, category="port_scan", severity="high", confidence=0.9, affected=F.col("dst"), related=F.col("src"),
                         dedup_key=F.concat(F.lit("port_scan:"), "src", F.lit(":"), "dst"), title=F.lit("scan"), description=F.lit("d"),
                         action=F.lit("a"), rationale=F.lit("r"), extra={"n": F.lit(1)})

    want = sorted((r.category, r.us, r.affected_host) for r in plans.process(detect(data)).collect())
    assert sum(w[0] == "incident" for w in want) >= 2
    mute = spark.createDataFrame([(want[-1][2], T0)], "dedup_key string, us long")
    for k, cuts in enumerate(([0, 30, 100], [0, 2, 4, 6, 21, 24, 100])):
        out = str(tmp_path / f"out{k}")
        kept = str(tmp_path / f"evidence{k}")
        step = batches.alert_batches(detect, out, mutes=mute, evidence=kept)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            step(data.where((F.col("event_id") >= a) & (F.col("event_id") < b)), i)
        stored = spark.read.parquet(out)
        assert sorted((r.category, r.us, r.affected_host) for r in stored.collect()) == want
        rows_kept = {(r.actor, r.us, r.alert_us) for r in spark.read.parquet(kept).collect()}
        alerts_at = [r.us for r in stored.where("category = 'port_scan'").collect()]
        for r in stored.where("category = 'incident'").collect():
            assert {t for a, us, t in rows_kept if (a, us) == (r.affected_host, r.us)} == {t for t in alerts_at if r.us - 300 * S <= t <= r.us}


def test_stream_counter_passes_over_nulls(spark, tmp_path):
    path = str(tmp_path / "conn")
    batch = traffic(spark, path, n=90)
    value = F.when(F.col("dst_port") == 443, None).otherwise(F.col("dst_ip"))
    stream = stream_events(spark, "connections", path, maxFilesPerTrigger=1).withColumn("v", value)
    got = run(stateful.sliding_distinct_stream(stream, ["src_ip"], "v", 30 * S), tmp_path, "nulls")
    want = sliding_distinct(batch.withColumn("v", value).select("us", "event_id", "src_ip", "v"), ["src_ip"], "v", 30 * S, "n")
    late = T0 + 10 ** 5 * S
    assert {(r.event_id, r.n_distinct) for r in got.collect()} == {(r.event_id, r.n) for r in want.collect() if r.us < late}


def flows(spark, path, late_us):
    """Beacons, ties, idle gaps and irregular traffic of several flows, in files whose rows are shuffled within bounds."""
    import random
    import time
    rng, rows = random.Random(3), []
    for f in range(6):
        t, dst = T0 + f * S, f"203.0.113.{f}"
        for i in range(90):
            step = [60, 60, 60, 300, 7, 2][f] * S
            t += step + rng.randrange(0, [1, 2, step // 20, step // 12, step // 2, step][f])
            if i == 45 and f in (0, 2):
                t += 4000 * S  # idle for longer than a flow lives
            rows += [(t, "192.168.1.5", dst, 8443)] * (2 if i % 10 == 3 else 1)
    rows.sort()
    chunks = [rows[k * len(rows) // 5:(k + 1) * len(rows) // 5] for k in range(5)]
    for chunk in chunks:
        rng.shuffle(chunk)
    for chunk in [*chunks, [(late_us, "0.0.0.0", "0.0.0.0", 1)], [(late_us + 10 ** 5 * S, "0.0.0.0", "0.0.0.0", 1)]]:
        df = spark.createDataFrame(chunk, "us long, src_ip string, dst_ip string, dst_port int")
        df.select(F.timestamp_micros("us").alias("ts"), "src_ip", F.lit(1).alias("src_port"), "dst_ip", "dst_port", F.lit("tcp").alias("protocol"),
                  F.lit("S").alias("flags"), F.lit(10).cast("bigint").alias("size"), F.lit("s").alias("sensor")).coalesce(1).write.mode(
                      "append").parquet(path)
        time.sleep(1.1)
    return canonical(spark.read.schema(SCHEMAS["connections"]).parquet(path))


@pytest.mark.parametrize("history", [200, 12, None])
def test_streamed_beacons_equal_batch(spark, tmp_path, history):
    from lanwatch.operators.beacon import beacon
    path, late = str(tmp_path / "conn"), T0 + 10 ** 6 * S
    batch = flows(spark, path, late)
    cfg = Config(beacon_history=history)
    baseline = spark.createDataFrame([("192.168.1.5", "203.0.113.0", 8443, "tcp")], "src_ip string, dst_ip string, dst_port int, protocol string")
    key = ["dedup_key", "us", "severity", "confidence", "title", "extra"]
    want = sorted(tuple(r) for r in beacon(batch, cfg, baseline).where(F.col("us") < late).select(*key).collect())
    stream = stream_events(spark, "connections", path, maxFilesPerTrigger=1)
    got = sorted(tuple(r) for r in run(stateful.beacon_stream(stream, cfg, baseline), tmp_path, f"beacons{history}").select(*key).collect())
    assert len(want) > 5 and got == want


def test_first_seen_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    import shutil

    from lanwatch.operators.firsts import first_seen
    path = str(tmp_path / "conn")
    batch = traffic(spark, path)
    baseline = batch.where("dst_ip like '%.2_'").select("src_ip", "dst_ip").distinct().limit(3).cache()
    want = {(r.src_ip, r.dst_ip, r.event_id) for r in first_seen(batch.select("us", "event_id", "src_ip", "dst_ip"), ["src_ip"], "dst_ip", baseline).collect()
            if r.us < T0 + 10 ** 5 * S}
    files = sorted((tmp_path / "conn").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    part = tmp_path / "part"
    part.mkdir()
    got = set()
    for k, some in enumerate((files[:2], files[2:])):  # two runs over one checkpoint
        for f in some:
            shutil.copy2(f, part / f.name)
        stream = stream_events(spark, "connections", str(part), maxFilesPerTrigger=1)
        out = stateful.first_seen_stream(stream, ["src_ip"], "dst_ip", baseline)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode(
            "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = [(r.src_ip, r.dst_ip, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_state_is_empty_after_its_time(spark, tmp_path):
    path, late = str(tmp_path / "conn"), T0 + 10 ** 6 * S
    flows(spark, path, late)
    stream = stream_events(spark, "connections", path, maxFilesPerTrigger=1).where("dst_port <> 1 or us > 0")
    for name, out, states in (("cool", stateful.cooldown_stream(stream.where("dst_port = 8443 or dst_ip = '0.0.0.0'"), ["dst_ip"], 60), ["last", "waiting"]),
                              ("beac", stateful.beacon_stream(stream), ["flow", "gaps", "kept", "waiting"]),
                              ("firs", stateful.first_seen_stream(stream, ["src_ip"], "dst_ip", keep_seconds=600), ["known", "waiting"])):
        run(out, tmp_path, name)
        for state in states:
            left = spark.read.format("statestore").option("stateVarName", state).load(str(tmp_path / name))
            kept = [r for r in left.collect() if "0.0.0.0" not in str(r)]
            assert not kept, (name, state, kept[:3])


def test_reports_equal_the_whole_table_after_late_rows(spark, tmp_path):
    from lanwatch.plans import reports
    hour, now = 3600 * S, T0 + 80 * 3600 * S
    rows = [(i, T0 + (i * 37 % 81) * hour + i, ["low", "high", "critical"][i % 3], [None, "s1", "s2"][i % 7 % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, us long, severity string, sensor string").cache()
    path = str(tmp_path / "r")
    tick = batches.report_batches(path, lambda: now)
    for k in (0, 1, 2, 2):  # late rows in every batch; the last one is tried twice
        tick(df.where(F.col("event_id") % 3 == k), k)
    tick(df.limit(0), 3)
    got = {(r.report, r.name): (r.value, r.stale) for r in batches.last_report(spark, path).collect()}
    since = (now // hour - 24) * hour
    want = {("severity", r.severity): (r.cnt, None) for r in reports.alerts_by_severity(df, since).collect()}
    for r in reports.sensor_rollup(df, since).collect():
        want |= {("sensor", r.sensor): (r.alert_count, None), ("sensor_last", r.sensor): (r.last_seen, None)}
    whole = reports.source_freshness(df.withColumn("sensor", F.coalesce("sensor", F.lit("local"))), "sensor", now)
    want |= {("freshness", r.sensor): (r.last_event, r.stale) for r in whole.collect()}
    assert got == want
    table = batches.Partials(f"{path}/hours", ["hour", "severity", "sensor"], {"n": "sum", "last_us": "max"})
    day = (now // hour - 24) // 24
    opened = table.opened(spark, day)
    assert opened and all(int(f.split("day=")[1].split("/")[0]) >= day for f in opened) and len(opened) < len(table.opened(spark))


def test_baselines_do_not_depend_on_the_cut_into_batches(spark, tmp_path):
    from lanwatch.operators import baseline
    cfg = Config(subnets=("192.168.0.0/16",))
    rows = [(i, T0 + i * 1700 * S + i % 7, f"192.168.1.{i % 3}", f"203.0.113.{i % 5}", [443, 22][i % 2], "tcp", "S", i) for i in range(240)]
    conn = spark.createDataFrame(rows, "event_id long, us long, src_ip string, dst_ip string, dst_port int, protocol string, flags string, size long").cache()
    whole = {"hourly": baseline.hourly_baseline(conn, cfg), "destinations": baseline.destination_baseline(conn),
             "hours": baseline.host_hours(conn, cfg), "profile": baseline.host_profile(conn, cfg)}
    for kind, want in whole.items():
        path = str(tmp_path / kind)
        assert batches.read_baseline(spark, kind, path) is None
        step = batches.baseline_batches(kind, path, cfg)
        for k in (0, 1, 1, 2, 3):  # one batch is tried twice; rows of one minute and day lie in several batches
            step(conn.where(F.col("event_id") % 4 == k), k)
            if k == 2:
                table = batches.baseline_table(kind, path)
                assert table.compact(spark, 10 ** 6, 2) > 0
                assert table.compact(spark, 10 ** 6, 2) == 0
        got = batches.read_baseline(spark, kind, path).select(*want.columns)

        def plain(df):
            return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert plain(got) == plain(want), kind
