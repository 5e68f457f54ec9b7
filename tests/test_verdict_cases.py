"""Odd values on both sides of every size switch: NaN, NULL, ties, repeated ids, late rows, batch cuts."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from flowlake.operators import audit, behaviour, metrics, police, stats, windows


def test_quantiles_agree_on_both_paths(spark):
    rows = [(float(i) if i % 2 else float("nan"), None) for i in range(200)] + [(None, None)] * 5
    df = spark.createDataFrame(rows, "x double, nothing double")
    wanted = [0.0, 0.25, 0.3, 0.5, 0.75, 1.0]
    small, large = (stats.exact_quantiles(df, "x", wanted, limit) for limit in (10**9, 0))
    assert small == pytest.approx(large, abs=0) and small[3] == 100.0
    assert stats.quantile_table(df, ["x"], wanted)["x"] == small
    for limit in (10**9, 0):
        assert all(map(math.isnan, stats.quantile_table(df, ["nothing"], [0.5], limit)["nothing"]))
        _, report = stats.iqr_outliers(df, ["x"], in_memory_rows=limit)
        assert report[0]["lower_bound"] == pytest.approx(small[1] - 3 * (small[4] - small[1]))
    assert stats.scale_stats(df, ["x"], "robust") == stats.scale_stats(df, ["x"], "robust", 0)


def test_auc_leaves_out_rows_without_a_score(spark):
    rows = [(1, 0.9), (0, 0.1), (1, None), (0, None), (1, float("nan"))]
    r = metrics.roc_auc(spark.createDataFrame(rows, "y int, score double")).first()
    assert (r["positives"], r["negatives"], r["auc"]) == (1, 1, 1.0)


def test_missing_and_unknown_protocols_are_one_entry(spark):
    rows = [("2024-01-01 00:00:00", p) for p in (None, "unknown", "TCP", None)]
    packets = spark.createDataFrame(rows, "ts string, protocol string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert windows.protocol_counts(packets).first()["protocol_counts"] == {"unknown": 3, "TCP": 1}


def test_port_scan_with_repeated_ids_agrees_on_both_paths(spark):
    rows = [(f"10.0.0.{i % 2}", i % 7 if i % 5 else None, f"2024-01-01 00:00:{i % 50:02d}", i % 6 if i % 11 else None) for i in range(200)]
    packets = spark.createDataFrame(sorted(set(rows), key=str), "src_ip string, dst_port int, ts string, packet_id int")
    packets = packets.withColumn("ts", F.col("ts").cast("timestamp"))

    def counts(limit):
        out = behaviour.port_scan(packets, max_group_rows=limit)
        last = out.groupBy("src_ip", "ts").agg(F.max("ports_seen").alias("n"), F.count("*").alias("rows"))
        return sorted(map(tuple, last.collect()))

    assert counts(10**9) == counts(5) and sum(r[3] for r in counts(5)) == packets.count()


def test_an_old_packet_fills_the_bucket():
    bucket = police.Bucket(rate=1000, capacity=1000, tokens=1000)
    assert bucket.admit(5_000_000_000, 900) and not bucket.admit(5_000_000_000, 900)
    assert bucket.admit(4_999_999_999, 1000) and bucket.tokens == 0


def test_history_does_not_depend_on_batches(spark):
    rows = [(i, f"10.0.0.{i % 3 if i % 4 else 0}", 1_700_000_000 + 7 * i, math.sin(i)) for i in range(400)]
    flows = spark.createDataFrame(rows, "packet_id int, src_ip string, at long, if_score double").withColumn("ts", F.timestamp_seconds("at"))
    whole = behaviour.source_history(flows, history=20)
    names = ["packet_id", "interval_raw", "mean_score", "mean_interval", "ip_flow_count", "is_periodic"]
    past, parts = None, []
    for low, high in ((0, 1), (1, 150), (150, 155), (155, 400)):
        out, past = behaviour.history_after(flows.filter(F.col("packet_id").between(low, high - 1)), past, history=20)
        parts += out.select(*names).collect()
    want = {r["packet_id"]: r for r in whole.select(*names).collect()}
    assert len(parts) == len(want) == 400
    for r in parts:
        assert tuple(r) == pytest.approx(tuple(want[r["packet_id"]]), nan_ok=True)


def _log_lines(n):
    """JSON lines as an append-only log writes them, keys in any order."""
    rng, before, out = random.Random(2), "0" * 64, []
    for i in range(n):
        fields = {"zeta": i, "Ünicode": "日本 \u20ac \\ \" \n", "a": {"y": [1, 2.5, None, True], "x": {"ß": "", "B": 1e20}}}
        payload = {"ts": f"2024-01-01T00:00:{i:02d}", "event": "login", "fields": fields, "prev_hash": before}
        text = json.dumps(payload, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        before = hashlib.sha256((payload["prev_hash"] + text).encode()).hexdigest()
        keys = list({**payload, "hash": before}.items())
        rng.shuffle(keys)
        out.append(json.dumps(dict(keys), ensure_ascii=bool(i % 2)))
    return out


def test_audit_files_verify_as_written(spark, tmp_path):
    good, files = _log_lines(30), {}
    files["good"] = (good[:10] + [""] + good[10:], True, "ok")
    files["forged"] = ([*good[:4], good[4].replace("login", "logout"), *good[5:]], False, "hash mismatch at line 5")
    files["missing"] = (good[:7] + good[8:], False, "hash chain break at line 8")
    files["torn"] = ([*good[:3], good[3][:40]], False, "hash chain break at line 4")
    files["array"] = (["[1, 2]"], False, "hash chain break at line 1")
    for name, (lines, _, _) in files.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    for limit in (10**9, 6):
        lines = audit.scan_audit_lines(spark, str(tmp_path), limit)
        got = {r["log_id"].rsplit("/", 1)[1][:-6]: (r["ok"], r["message"]) for r in audit.chain_verify(lines, max_group_rows=limit).collect()}
        assert got == {n: (ok, message) for n, (_, ok, message) in files.items()}


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": {"d": [1.50, 2], "c": "é"}}', "[]", None, "no json", '"x"', '{"a":1,"a":2}']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", audit.canonical_json("t").alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ['{"a":{"c":"é","d":[1.5,2]},"b":1}', "[]", None, None, '"x"', '{"a":2}']
