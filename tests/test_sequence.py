"""Ordered per-key operators: hand cases, brute force, and chunked equals plain."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowlake.operators import audit, behaviour, health, police
from flowlake.operators.sequence import POSITION, Running, Stage, ordered, positions

T0 = 1_704_067_200_000_000


def _ts(us):
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


@pytest.fixture(scope="module")
def hot(spark):
    """One source with most of the rows, some small ones, a NULL source, equal times."""
    rng = random.Random(7)
    rows, now = [], T0
    for i in range(1500):
        now += rng.choice([0, 10, 1_000_000, 40_000_000])
        src = "10.0.0.1" if rng.random() < 0.8 else rng.choice(["10.0.0.2", "10.0.0.3", None])
        rows.append((i, _ts(now), src, "192.168.0.1", 1000, rng.randint(1, 40), "TCP", rng.randint(60, 1500), rng.uniform(-1, 0.1)))
    schema = "packet_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_size long, if_score double"
    return spark.createDataFrame(rows, schema).cache()


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_positions_are_exact(hot):
    plain = hot.groupBy("src_ip").count().collect()
    got = positions(hot, ["src_ip"], ["ts", "packet_id"])
    for r in plain:
        mine = got.filter(F.col("src_ip").eqNullSafe(r["src_ip"])).orderBy("ts", "packet_id").collect()
        assert [m[POSITION] for m in mine] == list(range(1, r["count"] + 1))


def test_running_aggregates_chunked_equal_plain(hot):
    stages = [
        Stage(lambda w: {"before": F.lag("packet_size", 2).over(w)}, 2),
        Running({"total": F.col("packet_size")}, "sum", exclusive=True),
        Running({"low": F.col("total") - F.col("packet_id") * 900}, "min", exclusive=True),
        Running({"top": F.when(F.col("packet_size") > 1000, F.col(POSITION))}),
    ]
    columns = ["packet_id", POSITION, "before", "total", "low", "top"]
    plain = ordered(hot, ["src_ip"], ["ts", "packet_id"], stages)
    chunked = ordered(hot, ["src_ip"], ["ts", "packet_id"], stages, max_group_rows=37)
    order = lambda df: [tuple(r) for r in df.select(*columns).orderBy("packet_id").collect()]
    assert order(plain) == order(chunked)


def test_history_chunked_equals_plain_and_brute_force(hot):
    columns = ["packet_id", "interval_raw", "mean_interval", "ip_flow_count", "is_burst", "is_slow", "is_periodic", "interval_delta"]
    known = hot.filter("src_ip IS NOT NULL")
    plain = {r["packet_id"]: r for r in behaviour.source_history(known).collect()}
    chunked = behaviour.source_history(known, max_group_rows=150)
    assert _rows(chunked, *columns) == sorted(tuple(r[c] for c in columns) for r in plain.values())
    seen = {}
    for r in sorted(known.collect(), key=lambda r: (r["ts"], r["packet_id"])):
        gaps, scores, last = seen.setdefault(r["src_ip"], ([], [], [None]))
        gap = 0.0 if last[0] is None else (r["ts"] - last[0]).total_seconds()
        last[0] = r["ts"]
        gaps.append(gap), scores.append(r["if_score"])
        window, recent = gaps[-100:], scores[-100:]
        got = plain[r["packet_id"]]
        assert got["interval_raw"] == pytest.approx(gap)
        assert got["mean_score"] == pytest.approx(sum(recent) / len(recent))
        assert got["ip_score_delta"] == pytest.approx(r["if_score"] - sum(recent) / len(recent))
        if len(window) >= 2:
            assert got["mean_interval"] == pytest.approx(sum(window) / len(window))
        else:
            assert got["mean_interval"] is None
        periodic = len(window) >= 5 and sum(window) > 0 and statistics.stdev(window) / statistics.mean(window) < 0.25
        assert got["is_periodic"] == int(periodic)
        assert got["ip_flow_count"] == min(len(gaps), 1000)


def test_beacon_hand_cases(spark):
    regular = [(i, _ts(T0 + i * 1_000_000), "a") for i in range(15)]
    rng = random.Random(1)
    irregular, now = [], T0
    for i in range(10):
        now += rng.randint(100_000, 9_000_000)
        irregular.append((100 + i, _ts(now), "b"))
    df = spark.createDataFrame(regular + irregular, "packet_id long, ts timestamp, src_ip string")
    out = behaviour.beacons(df, keys=("src_ip",)).collect()
    assert sorted(r["packet_id"] for r in out if r["is_beacon"]) == list(range(9, 15))
    assert all(r["gap_variance"] == 0 for r in out if r["src_ip"] == "a")
    assert [r["is_beacon"] for r in out if r["src_ip"] == "b"] == [False]


def test_beacon_chunked_equals_plain(hot):
    columns = ["packet_id", "n_timestamps", "is_beacon"]
    keys = ("src_ip",)
    assert _rows(behaviour.beacons(hot, keys, max_group_rows=64), *columns) == _rows(behaviour.beacons(hot, keys), *columns)


def test_port_scan_chunked_equals_plain_and_brute_force(hot):
    columns = ["packet_id", "ports_seen", "is_scan"]
    plain = _rows(behaviour.port_scan(hot), *columns)
    assert _rows(behaviour.port_scan(hot, max_group_rows=100), *columns) == plain
    ports, want = {}, []
    for r in sorted(hot.filter("src_ip IS NOT NULL").collect(), key=lambda r: (r["ts"], r["packet_id"])):
        mine = ports.setdefault(r["src_ip"], set())
        mine.add(r["dst_port"])
        want.append((r["packet_id"], len(mine), len(mine) > 5))
    assert plain == sorted(want)


def test_token_bucket_keeps_fractions():
    bucket = police.Bucket(rate=10_000_000, capacity=10_000_000, tokens=0, last=0)
    for step in range(1, 1001):
        bucket.refill(step * 50)
    assert bucket.tokens == 500


@pytest.mark.parametrize("rate,capacity,limit", [(100_000, 100_000, 2_000_000), (40, 1500, 2_000_000), (3000, 2500, 2_000_000), (3000, 2500, 90)])
def test_rate_police_matches_a_plain_fold(hot, rate, capacity, limit):
    known = hot.filter("src_ip IS NOT NULL").withColumn("ts", F.timestamp_micros(F.floor((F.unix_micros("ts") - T0) / 40) + T0))
    got = dict(_rows(police.rate_police(known, rate=rate, capacity=capacity, max_group_rows=limit), "packet_id", "passed"))
    buckets = {}
    for r in sorted(known.collect(), key=lambda r: (r["ts"], r["packet_id"])):
        bucket = buckets.setdefault(r["src_ip"], police.Bucket(rate, capacity, capacity))
        ns = int((r["ts"] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5) * 1000
        assert got[r["packet_id"]] == bucket.admit(ns, r["packet_size"]), r


def test_cooldown_is_greedy_and_chunk_safe(spark):
    rng = random.Random(3)
    rows, now = [], 0
    for _ in range(600):
        now += rng.choice([0, 20, 90, 310])
        rows.append((rng.choice("aab"), "high_cpu", _ts(T0 + now * 1_000_000), "warning", "m"))
    df = spark.createDataFrame(rows, "sensor string, alert_type string, ts timestamp, severity string, message string")
    want, last = [], {}
    for sensor, kind, ts, *_ in sorted(rows, key=lambda r: r[2]):
        if sensor not in last or (ts - last[sensor]).total_seconds() >= 300:
            last[sensor] = ts
            want.append((sensor, ts))
    for limit in (2_000_000, 25):
        assert _rows(health.alert_cooldown(df, max_group_rows=limit), "sensor", "ts") == sorted(want)


def test_chain_verify_finds_the_first_break(spark):
    def chain(log, n):
        prev, out = audit.GENESIS, []
        for i in range(1, n + 1):
            out.append([log, i, f"t{i}", 'ev"il', '{"k":1}', prev])
            text = '{"event":"ev\\"il","fields":{"k":1},"prev_hash":"%s","ts":"t%d"}' % (prev, i)
            import hashlib

            prev = hashlib.sha256((out[-1][5] + text).encode()).hexdigest()
            out[-1].append(prev)
        return out

    good, broken, forged = chain("good", 40), chain("broken", 40), chain("forged", 40)
    broken[20][5] = "0" * 64
    forged[30][4] = '{"k":2}'
    schema = "log_id string, line_no int, ts string, event string, fields string, prev_hash string, hash string"
    df = spark.createDataFrame(good + broken + forged, schema)
    for limit in (2_000_000, 10):
        out = {r["log_id"]: (r["ok"], r["message"]) for r in audit.chain_verify(df, max_group_rows=limit).collect()}
        assert out == {
            "good": (True, "ok"),
            "broken": (False, "hash chain break at line 21"),
            "forged": (False, "hash mismatch at line 31"),
        }


def test_health_chunked_equals_plain(spark, sf_dir):
    from flowlake.plans import fixtures as fx

    limits = {**health.LIMITS, "drop": 20.0, "queue": 2}
    snapshots = fx.v_health(spark, sf_dir).cache()
    columns = ["sensor", "ts", "capture_rate_pps", "processing_rate_pps", "drop_rate_percent"]
    rated = health.health_rates(snapshots)
    assert _rows(rated, *columns) == _rows(health.health_rates(snapshots, max_group_rows=20), *columns)
    alerts = health.threshold_alerts(rated, limits)
    plain = health.alert_resolution(alerts, rated, limits)
    chunked = health.alert_resolution(alerts, rated, limits, max_group_rows=15)
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(plain) == order(chunked)
