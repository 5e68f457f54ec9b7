"""Windows, decisions, inspectors, statistics and samples on small hand cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


from flowlake.operators import blocklist, clean, decide, health, inspect, metrics, retention, sampling, stats, windows

UTC0 = dt.datetime(2024, 1, 1)
SALT = "a test salt"


def _packets(spark, rows):
    schema = "packet_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_size long"
    return spark.createDataFrame(
        [(i, UTC0 + dt.timedelta(seconds=s), a, b, p, q, proto, n) for i, (s, a, b, p, q, proto, n) in enumerate(rows)], schema
    )


def test_windows_count_traffic_without_addresses_but_no_flow(spark):
    p = _packets(
        spark,
        [
            (0, "10.0.0.1", "10.0.0.2", 1, 80, "TCP", 100),
            (1, "10.0.0.1", "10.0.0.2", 1, 80, "TCP", 50),
            (2, "10.0.0.2", "10.0.0.1", 80, 1, "TCP", 500),
            (3, "unknown", "unknown", None, None, "unknown", 40),
            (7, "::1", "0:0:0:0:0:0:0:1", None, None, "IPv6", 60),
            (8, "0:0::1", "::1", None, None, "IPv6", 60),
        ],
    )
    rows = sorted(windows.window_stats(p, 5).collect(), key=lambda r: r["window_start"])
    assert [(r["packet_count"], r["byte_count"], r["unique_flows"]) for r in rows] == [(4, 690, 2), (2, 120, 1)]
    assert rows[0]["rate_pps"] == 0.8 and rows[0]["rate_bps"] == 1104.0
    flows = windows.flow_rows(p, SALT, 5).collect()
    first = next(r for r in flows if r["src_port"] == 1)
    assert (first["src_flow_packets"], first["src_flow_bytes"], first["dst_flow_packets"], first["dst_flow_bytes"]) == (2, 150, 1, 500)
    assert len(flows) == 3
    counters = windows.traffic_counters(p, 5).first()
    assert tuple(counters) == (6, 810, 2, 3)
    assert windows.protocol_counts(p, 5).orderBy("window_start").first()["protocol_counts"] == {"TCP": 3, "unknown": 1}


def test_harmonise_by_presence_and_missing_columns(spark):
    df = spark.createDataFrame([("a", "b", None, 5, 2.0)], "src_ip_anon string, dst_ip_anon string, src_flow_bytes long, packet_count long, duration_seconds double")
    r = clean.harmonise_schema(df).first()
    assert (r["src_ip"], r["bytes_in"], r["bytes_out"], r["packets_in"], r["packets_out"], r["duration"]) == ("a", None, 0, 5, 0, 2.0)
    with pytest.raises(ValueError, match="duration"):
        clean.require_columns(df, ["duration"])


def test_explanations_from_scaler_statistics(spark):
    table = {"f1": (10.0, 2.0), "f2": (100.0, 10.0), "f3": (5.0, 1.0)}
    df = spark.createDataFrame([(14.0, 90.0, 5.0)], "f1 double, f2 double, f3 double")
    values = {c: F.col(c) for c in table}
    assert df.select(decide.top_deviations(values, table)).first()[0] == "f1 (+2.0σ), f2 (-1.0σ), f3 (+0.0σ)"
    flat = {"f1": (10.0, 0.0), "f2": (100.0, 10.0)}
    assert df.select(decide.top_deviations(values, flat, 1)).first()[0] == "f2 (-1.0σ)"


def test_verdict_merge_hand_cases(spark):
    rows = [("pass", -1, None), ("escalate", -1, 0.1), ("escalate", 1, 0.8), ("escalate", -1, 0.5), ("if_only", -1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, prediction int, payload_score double")
    out = [(r["prediction"], r["skip_enforcement"]) for r in decide.verdict_merge(df).orderBy("i").collect()]
    assert out == [(1, True), (1, True), (-1, False), (-1, False), (-1, False)]


def test_route_rules_and_downgrade(spark):
    rows = [(-0.1, -0.1, 21, True), (-0.1, -0.1, 20, True), (-0.8, -0.5, 5, False), (-0.5, -0.5, 5, True), (-0.5, -0.5, 5, False), (-0.1, -0.3, 50, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s double, m double, n int, p boolean")
    route = decide.route_rules(F.col("s"), F.col("m"), F.col("n"), F.col("p"))
    out = df.withColumn("r", route).withColumn("d", decide.route_downgrade(F.col("r"), F.col("p"))).orderBy("i").collect()
    assert [tuple(r["r"]) for r in out] == [("pass", 0.75), ("if_only", 0.8), ("escalate", 0.9), ("escalate", 0.65), ("if_only", 0.6), ("if_only", 0.8)]
    assert out[2]["d"]["path"] == "if_only" and out[2]["d"]["confidence"] == pytest.approx(0.72)


def test_router_labels(spark):
    rows = [(1, None, 1), (-1, None, 1), (1, 0.2, 0), (-1, 0.7, 1), (1, 0.65, 2), (-1, 0.1, 2)]
    df = spark.createDataFrame(rows, "v int, c double, want int")
    assert all(r[0] == r[1] for r in df.select("want", decide.router_label(F.col("v"), F.col("c"))).collect())


def test_inspectors_on_hand_payloads(spark):
    payloads = {
        "pii": "mail me at jo@x.org, call 0123456789 or 0123456789",
        "phi": "..DICM PatientName=X PatientID=1",
        "phi_clean": "DICM only",
        "shell": "run wget now",
        "decoy": "GET /.env and /wp-config.php",
        "pqc": "x25519_kyber768 p256_kyber768 falcon",
        "drill": "<b>RedTeam-XSS-Probe</b>",
        "noise": "é" * 100,
        "short_noise": "é" * 64,
        "plain": "hello there",
    }
    df = spark.createDataFrame(list(payloads.items()), "name string, payload string")
    out = {}
    for r in inspect.findings(inspect.InspectorRegistry().run(df), "name").collect():
        out.setdefault(r["name"], {})[r["inspector"]] = r
    assert out["pii"]["pii"]["details"] == "Emails found: 1, Phones found: 2"
    assert (out["phi"]["phi"]["score"], out["phi"]["phi"]["threat_level"]) == (20, "CRITICAL")
    assert out["phi_clean"]["phi"]["alert"] is None and out["phi_clean"]["phi"]["info"]
    assert out["shell"]["shell_commands"]["details"] == "wget"
    assert out["decoy"]["decoy_paths"]["details"].startswith("Wordpress Config Trap")
    assert out["pqc"]["pqc"]["details"] == "Falcon-General, Hybrid-Kyber-TLS"
    assert out["drill"]["drill_marker"]["info"]
    assert "high_entropy" in out["noise"] and "short_noise" not in out and "plain" not in out


def test_byte_signatures_in_binary_payloads(spark):
    sig = inspect.PQC_SIGNATURES[2][0]
    df = spark.createDataFrame([(bytearray(b"\xff\xfe" + sig + b"\x00"),), (bytearray(sig[:-1]),)], "p binary")
    assert [r[0]["details"] if r[0] else None for r in df.select(inspect.pqc(inspect.byte_text(F.col("p")))).collect()] == ["Kyber1024", None]


def test_signature_scores(spark):
    rows = [
        ("", 0.9, 0.0, None), ("GET /index.html", 0.5, 0.05, 0.1), ("GET / <SCRIPT>alert", 0.2, 0.55, 0.7),
        ("cat /etc/passwd /bin/sh cmd.exe", 0.3, 0.9, 1.0), ("PUT /x", 0.5, 0.05, 0.5), ("GET /?q='", 0.5, 0.05, 0.5),
    ]
    df = spark.createDataFrame(rows, "p string, base double, a double, b double")
    for r in df.select("*", inspect.signature_score_a(F.col("base"), F.col("p")).alias("ga"), inspect.signature_score_b(F.col("base"), F.col("p")).alias("gb")).collect():
        assert r["ga"] == pytest.approx(r["a"]), r["p"]
        if r["b"] is not None:
            assert r["gb"] == pytest.approx(r["b"]), r["p"]


def test_blocklist_upsert_replaces_and_validates(spark):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    old = spark.sql(
        "SELECT '10.0.0.1' ip_address, 'old' reason, 'manual' source, 'low' risk_level, timestamp'2024-01-01' created_at, "
        "cast(null as timestamp) expires_at, false is_active, 'none' enforcement_action, 7L hit_count, timestamp'2024-01-01' last_seen, cast(null as string) metadata"
    )
    new = spark.createDataFrame(
        [("10.0.0.1", "first", "manual", "high", None, None, 1), ("10.0.0.1", "second", "manual", "medium", 2, None, 2),
         ("10.0.0.1", "other", "prediction", "low", None, None, 3), ("bad", "x", "manual", "low", None, None, 4), ("10.0.0.2", "x", "manual", "severe", None, None, 5)],
        "ip_address string, reason string, source string, risk_level string, ttl_hours int, metadata string, seq long",
    )
    out = {(r["ip_address"], r["source"]): r for r in blocklist.upsert(old, new, as_of).collect()}
    assert set(out) == {("10.0.0.1", "manual"), ("10.0.0.1", "prediction")}
    row = out[("10.0.0.1", "manual")]
    assert (row["reason"], row["hit_count"], row["is_active"], row["expires_at"]) == ("second", 0, True, dt.datetime(2024, 2, 1, 2))
    hashed = blocklist.upsert(old, new, as_of, SALT).filter("source = 'prediction'").first()["ip_address"]
    assert hashed.startswith("ip_")


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(10)
    assert "broadcast" in blocklist.maybe_broadcast(df, 10)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in blocklist.maybe_broadcast(df, 9)._jdf.queryExecution().toString().lower()


def test_trust_add_is_idempotent(spark):
    as_of = F.lit("2024-02-01").cast("timestamp")
    base = spark.sql("SELECT '1.1.1.1' ip, 'r' reason, timestamp'2024-01-01' timestamp, 'active' status")
    news = spark.createDataFrame([("1.1.1.1", "again"), ("2.2.2.2", "b"), ("2.2.2.2", "a")], "ip string, reason string")
    once = blocklist.trust_add(base, news, as_of)
    assert sorted(r["ip"] for r in blocklist.trust_add(once, news, as_of).collect()) == ["1.1.1.1", "2.2.2.2"]


def test_retention_keeps_audit_longer(spark):
    assert retention.audit_hours(24) == 2160 and retention.audit_hours(24 * 120) == 24 * 120
    df = spark.sql("SELECT explode(array(timestamp'2024-01-01', timestamp'2024-01-10', cast(null as timestamp))) ts")
    as_of = F.lit("2024-01-10 12:00:00").cast("timestamp")
    assert retention.purge(df, "ts", as_of, 24).count() == 2
    assert retention.retention_check(df, "ts", as_of).first()["old_rows"] == 1


def test_exact_quantiles_without_memory(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=700), np.full(300, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.77, 0.95, 1.0]
    for limit in (10_000, 10):
        assert stats.exact_quantiles(df, "v", probabilities, limit) == pytest.approx(list(np.quantile(values, probabilities)))
    table = stats.quantile_table(df, ["v"], [0.5], 10)
    assert table["v"] == pytest.approx([float(np.median(values))])


def test_running_totals(spark):
    df = spark.createDataFrame([(float(i * i % 997), i) for i in range(997)], "v double, n long").groupBy("v").agg(F.sum("n").alias("n"))
    rows = sorted((r["v"], r["n"], r["running_n"]) for r in stats.running_totals(df, "v", ["n"], 16).collect())
    total = 0
    for _, n, running in rows:
        total += n
        assert running == total


def test_iqr_removes_column_after_column(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=500), rng.normal(size=500)
    a[:5], b[3:9] = 50, -70
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    keep = np.ones(500, bool)
    want = []
    for col in (a, b):
        q1, q3 = np.quantile(col[keep], [0.25, 0.75])
        bad = keep & ((col < q1 - 3 * (q3 - q1)) | (col > q3 + 3 * (q3 - q1)))
        want.append((int(keep.sum()), int(bad.sum())))
        keep &= ~bad
    for limit in (10_000, 50):
        left, report = stats.iqr_outliers(df, ["a", "b"], in_memory_rows=limit)
        assert [(r["rows_before"], r["outliers"]) for r in report] == want and left.count() == keep.sum()


def test_auc_and_threshold_search(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 1), round(rng.gauss(0, 1), 1)) for _ in range(400)]
    data = [(y, round(s - y * 0.7, 1)) for y, s in data]
    df = spark.createDataFrame(data, "y int, score double")
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(auc)
    table = metrics.threshold_search(df, target_precision=0.8).collect()
    scores = np.array([s for _, s in data])
    labels = np.array([y for y, _ in data])
    best = None
    for r in sorted(table, key=lambda r: r["percentile"]):
        cut = np.percentile(scores, r["percentile"])
        flagged = scores < cut
        assert r["threshold"] == pytest.approx(cut)
        assert (r["tp"], r["fp"]) == (int((flagged & (labels == 1)).sum()), int((flagged & (labels == 0)).sum()))
        if r["precision"] >= 0.8 and (best is None or r["precision"] > best[0]):
            best = (r["precision"], r["percentile"])
    assert [r["percentile"] for r in table if r["chosen"]] == [best[1]]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") == 1, "tiny").otherwise("b"))
    one, two = (sorted(r[0] for r in sampling.sample_cap(df.repartition(n), 77, ["id"]).select("id").collect()) for n in (1, 7))
    assert one == two and len(one) == 77
    assert sampling.sample_cap(df, 5000, ["id"]).count() == 1000
    split = sampling.train_test_split(df, ["id"], strata=["g"]).groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in split} == {("a", "test"): 67, ("a", "train"): 267, ("b", "test"): 133, ("b", "train"): 532, ("tiny", "test"): 1}
    assert sampling.train_test_split(df.limit(50), ["id"]).filter("split = 'test'").count() == 10
    assert sampling.train_test_split(df, ["id"]).count() == 1000


def test_data_sufficiency_reasons(spark):
    good = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "a double, b double")
    assert stats.data_sufficiency(good, ["a", "b"], 10).first()["reason"] == "Data validation passed"
    assert stats.data_sufficiency(good, ["a", "b"], 50).first()["reason"].startswith("Insufficient samples: 20 < 50")
    assert "zero variance" in stats.data_sufficiency(good.withColumn("b", F.lit(1.0)), ["a", "b"], 10).first()["reason"]
    holes = good.withColumn("b", F.when(F.col("a") > 3, F.col("b")))
    assert "NaN" in stats.data_sufficiency(holes, ["a", "b"], 10).first()["reason"]


def test_alert_rules_and_resolution(spark):
    rows = [(0, 5.0, 10, True, 95.0, 2000.0, 95.0), (60, 2.5, 2000, False, 80.0, 800.0, 85.0), (120, 0.5, 700, True, 60.0, 500.0, 70.0)]
    schema = "sensor string, ts timestamp, drop_rate_percent double, flows_in_queue long, interface_available boolean, cpu_usage_percent double, memory_usage_mb double, disk_usage_percent double"
    df = spark.createDataFrame([("s", UTC0 + dt.timedelta(seconds=s), *r) for s, *r in rows], schema)
    alerts = health.threshold_alerts(df)
    got = sorted((r["ts"].minute, r["alert_type"], r["severity"]) for r in alerts.collect())
    assert got == [
        (0, "high_cpu", "warning"), (0, "high_disk_usage", "critical"), (0, "high_drop_rate", "critical"), (0, "high_memory", "warning"),
        (1, "high_drop_rate", "critical"), (1, "interface_unavailable", "critical"), (1, "queue_overflow", "warning"),
    ]
    ends = {(r["ts"].minute, r["alert_type"]): r["resolved_at"].minute for r in health.alert_resolution(alerts, df).collect()}
    assert set(ends.values()) == {2}


def test_scrubbed_blocklist_match_prefers_source(spark):
    as_of = F.lit("2024-02-01").cast("timestamp")
    entries = spark.sql(
        "SELECT * FROM VALUES ('a','manual','low',timestamp'2024-01-01',cast(null as timestamp),true),('a','prediction','high',timestamp'2024-01-02',timestamp'2024-01-03',true),"
        "('b','manual','high',timestamp'2024-01-01',cast(null as timestamp),true),('c','manual','high',timestamp'2024-01-01',cast(null as timestamp),false) AS t(ip_address, source, risk_level, created_at, expires_at, is_active)"
    )
    flows = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, "c", "x")], "id int, src_ip string, dst_ip string")
    out = [(r["blocked_ip"], r["blocked_side"], r["block_risk"]) for r in blocklist.blocklist_match(flows, entries, as_of).orderBy("id").collect()]
    assert out == [("a", "src", "low"), ("b", "dst", "high"), (None, None, None)]
