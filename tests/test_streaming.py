"""Stream results equal batch results, across several micro-batches."""

import glob
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from flowlake.operators import behaviour, decide, health, police, windows
from flowlake.plans import fixtures as fx
from flowlake.session import scratch_path
from flowlake.streaming import run, stateful
from flowlake.streaming import windows as stream_windows


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The scored packets in four files in time order, one per micro-batch."""
    path = str(tmp_path_factory.mktemp("packets"))
    packets = fx.v_scores(spark, sf_dir).cache()
    cuts = packets.approxQuantile("packet_id", [0.25, 0.5, 0.75], 0.0)
    bounds = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        packets.filter((F.col("packet_id") > low) & (F.col("packet_id") <= high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path, packets


def _stream(spark, parts):
    return spark.readStream.schema(parts[1].schema).option("maxFilesPerTrigger", 1).parquet(parts[0])


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_window_stats_closed_windows(spark, parts):
    got = run.drain(stream_windows.window_stats(_stream(spark, parts), 300), "t")
    want = windows.window_stats(parts[1], 300)
    newest = parts[1].agg(F.max("ts")).first()[0]
    closed = want.filter(F.col("window_end") <= F.lit(newest) - F.expr("INTERVAL 10 MINUTES"))
    assert _rows(got, *want.columns) == _rows(closed, *want.columns)


def test_window_stats_include_open_windows(spark, parts):
    got = stream_windows.drain_window_stats(_stream(spark, parts), 300)
    want = windows.window_stats(parts[1], 300)
    assert _rows(got, *want.columns) == _rows(want, *want.columns)


def test_window_stats_go_on_after_a_stop(spark, parts, tmp_path):
    """Two stops: windows open at the first one grow and close later, none is there twice."""
    files = sorted(glob.glob(f"{parts[0]}/*.parquet"), key=os.path.getmtime)
    source, folder = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    for stop in (files[:2], files[2:]):
        for f in stop:
            shutil.copy(f, source)
            time.sleep(1.1)
        stream = spark.readStream.schema(parts[1].schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        got = stream_windows.drain_window_stats(stream, 7200, folder=folder)
        want = windows.window_stats(spark.read.parquet(str(source)), 7200)
        assert _rows(got, *want.columns) == _rows(want, *want.columns)
    again = stream_windows.drain_window_stats(stream, 7200, folder=folder)  # nothing new came
    assert _rows(again, *want.columns) == _rows(want, *want.columns)


def test_window_stats_of_an_empty_stream(spark, parts, tmp_path):
    stream = spark.readStream.schema(parts[1].schema).parquet(str(tmp_path))
    assert stream_windows.drain_window_stats(stream, 300).count() == 0


def test_protocol_counts(spark, parts):
    got = run.drain(stream_windows.protocol_counts(_stream(spark, parts), 3600), "t")
    want = {r["window_start"]: r["protocol_counts"] for r in windows.protocol_counts(parts[1], 3600).collect()}
    rows = got.collect()
    assert len(rows) > 100 and all(want[r["window_start"]] == r["protocol_counts"] for r in rows)


def test_history(spark, parts):
    columns = ["packet_id", "interval_raw", "mean_interval", "ip_flow_count", "is_burst", "is_slow", "is_periodic", "interval_delta"]
    got = run.drain(stateful.source_history(_stream(spark, parts)), "t")
    assert _rows(got, *columns) == _rows(behaviour.source_history(parts[1]), *columns)


def test_history_forgets_idle_sources(spark, parts):
    got = run.drain(stateful.source_history(_stream(spark, parts), idle_seconds=1), "t")
    assert got.count() == parts[1].count()
    busy = behaviour.source_history(parts[1]).filter("interval_raw > 0 AND interval_raw <= 1").count()
    assert got.filter("ip_flow_count > 1").count() == busy


def test_beacons_and_port_scan(spark, parts):
    columns = ["packet_id", "n_timestamps", "is_beacon"]
    got = run.drain(stateful.beacons(_stream(spark, parts), keys=("src_ip",)), "t")
    assert _rows(got, *columns) == _rows(behaviour.beacons(parts[1], keys=("src_ip",)), *columns)
    columns = ["packet_id", "ports_seen", "is_scan"]
    got = run.drain(stateful.port_scan(_stream(spark, parts)), "t")
    assert _rows(got, *columns) == _rows(behaviour.port_scan(parts[1]), *columns)


def test_rate_police(spark, parts):
    def dense(df):
        start = 1_704_067_200_000_000
        return df.withColumn("ts", F.timestamp_micros(F.floor((F.unix_micros("ts") - start) / 100_000) + start))

    got = run.drain(stateful.rate_police(dense(_stream(spark, parts)), 1, 600), "t")
    want = _rows(police.rate_police(dense(parts[1]), rate=1, capacity=600), "packet_id", "passed")
    assert _rows(got, "packet_id", "passed") == want
    assert {p for _, p in want} == {True, False}


def test_first_block_only(spark, parts):
    got = run.drain(stream_windows.first_block_only(decide.policy_decisions(_stream(spark, parts)), ), "t")
    blocked = decide.policy_decisions(parts[1]).filter("policy_tier = 'Isolate'")
    assert {r[0] for r in got.select("src_ip").collect()} == {r[0] for r in blocked.select("src_ip").collect()}
    assert got.count() <= blocked.count()


def test_alert_cooldown(spark, sf_dir, tmp_path):
    rated = health.health_rates(fx.v_health(spark, sf_dir)).cache()
    limits = {**health.LIMITS, "drop": 20.0, "queue": 2}
    path = str(tmp_path / "rated")
    middle = rated.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    for part in (rated.filter(F.col("ts") <= middle), rated.filter(F.col("ts") > middle)):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(rated.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run.drain(stateful.alert_cooldown(health.threshold_alerts(stream, limits), cooldown=86400.0), "t")
    want = health.alert_cooldown(health.threshold_alerts(rated, limits), cooldown=86400.0)
    assert _rows(got, "sensor", "alert_type", "ts", "severity") == _rows(want, "sensor", "alert_type", "ts", "severity")


@pytest.fixture(scope="module")
def snapshot_parts(spark, sf_dir, tmp_path_factory):
    """Raw health snapshots in three files in time order."""
    path = str(tmp_path_factory.mktemp("snapshots"))
    table = fx.v_health(spark, sf_dir).cache()
    low, high = table.select(F.unix_micros("ts").alias("u")).approxQuantile("u", [0.3, 0.6], 0.0)
    us = F.unix_micros("ts")
    for part in (table.filter(us <= low), table.filter((us > low) & (us <= high)), table.filter(us > high)):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path, table


def test_alert_stream_over_micro_batches(spark, snapshot_parts):
    path, table = snapshot_parts
    limits, folder = {**health.LIMITS, "drop": 20.0, "queue": 12}, scratch_path(spark, "t")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = run.drain(stateful.alert_stream(stream, limits, 30 * 3600.0), "t", folder=folder).cache()
    rated = health.health_rates(table).cache()
    alerts = health.threshold_alerts(rated, limits)
    rates = ["sensor", "ts", "capture_rate_pps", "processing_rate_pps", "drop_rate_percent"]
    assert _rows(rows.filter("kind = 'rate'"), *rates) == _rows(rated, *rates)
    kept = ["sensor", "alert_type", "ts", "severity", "message"]
    assert _rows(rows.filter("kind = 'alert'"), *kept) == _rows(health.alert_cooldown(alerts, cooldown=30 * 3600.0), *kept)
    want = health.alert_resolution(alerts, rated, limits)
    assert _rows(rows.filter("kind = 'resolved'"), *kept, "resolved_at") == _rows(want.filter("resolved"), *kept, "resolved_at")
    assert _rows(stateful.open_alerts(spark, folder, limits), *kept) == _rows(want.filter("NOT resolved"), *kept)
    assert want.filter("resolved").count() > 0


def _late_and_idle(spark, tmp_path, last):
    """Three batches of one source, a late row in the second; the third comes ``last`` of another source."""
    batches = [
        [(1, "a", 100.0, 1), (2, "a", 110.0, 2)],
        [(3, "a", 105.0, 3), (4, "a", 130.0, 1)],
        [(5, "b", last, 9)],
    ]
    schema = "packet_id bigint, src_ip string, ts timestamp, if_score double, dst_port int"
    for rows in batches:
        df = spark.createDataFrame(rows, "packet_id bigint, src_ip string, s double, dst_port int")
        df.select("packet_id", "src_ip", F.timestamp_seconds("s").alias("ts"), F.lit(0.5).alias("if_score"), "dst_port").coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_late_rows_do_not_turn_the_clock_back(spark, tmp_path):
    got = run.drain(stateful.source_history(_late_and_idle(spark, tmp_path, 140.0)), "t")
    assert {r["packet_id"]: (r["interval_raw"], r["ip_flow_count"]) for r in got.collect()} == {
        1: (0.0, 1), 2: (10.0, 2), 3: (0.0, 3), 4: (20.0, 4), 5: (0.0, 1),
    }


@pytest.mark.parametrize(
    ("make", "variables"),
    [
        (lambda s: stateful.source_history(s, idle_seconds=60, lateness="1 minute"), ["clock", "recent", "flows"]),
        (lambda s: stateful.beacons(s, keys=("src_ip",), idle_seconds=60, lateness="1 minute"), ["clock", "times"]),
        (lambda s: stateful.port_scan(s, idle_seconds=60, lateness="1 minute"), ["clock", "ports", "n_ports"]),
    ],
)
def test_state_of_idle_sources_is_dropped(spark, tmp_path, make, variables):
    folder = scratch_path(spark, "t")
    run.drain(make(_late_and_idle(spark, tmp_path, 5000.0)), "t", folder=folder)
    for name in variables:
        assert {r[0] for r in run.state_of(spark, folder, 0, name).select("key.src_ip").collect()} == {"b"}, name


def test_list_state_is_cut(spark, tmp_path):
    rows = [(i, "a", 100.0 + i) for i in range(1000)]
    for k in range(0, 1000, 100):
        df = spark.createDataFrame(rows[k : k + 100], "packet_id bigint, src_ip string, s double")
        df.select("packet_id", "src_ip", F.timestamp_seconds("s").alias("ts"), (F.col("packet_id") * 0.5).alias("if_score")).coalesce(1).write.mode("append").parquet(str(tmp_path))
    schema = "packet_id bigint, src_ip string, ts timestamp, if_score double"
    folder = scratch_path(spark, "t")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path))
    got = run.drain(stateful.source_history(stream, history=30), "t", folder=folder)
    want = behaviour.source_history(spark.read.schema(schema).parquet(str(tmp_path)), history=30)
    assert _rows(got, "packet_id", "mean_score", "ip_flow_count") == _rows(want, "packet_id", "mean_score", "ip_flow_count")
    held = run.state_of(spark, folder, 0, "recent")
    assert held.count() <= 60


def test_empty_stream_yields_an_empty_table(spark, parts, tmp_path):
    stream = spark.readStream.schema(parts[1].schema).parquet(str(tmp_path))
    out = run.drain_batches(stream, lambda batch: batch.select("packet_id"), "t")
    assert out.columns == ["packet_id"] and out.count() == 0
