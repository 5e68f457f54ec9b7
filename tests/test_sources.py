"""Files in and out."""

import base64
import glob
import json

import pytest
from pyspark.sql import functions as F

from flowlake import schemas
from flowlake.operators import clean
from flowlake.sources import flows, sinks

HEADER = ",".join(schemas.FLOW_COLUMNS)


def test_flow_csv_both_schemas(spark, tmp_path):
    (tmp_path / "flow.csv").write_text(
        HEADER + "\n2024-01-01 00:00:00,10.0.0.1,10.0.0.2,1,80,TCP,10,20,1,2,0.5\n"
        "2024-01-01 00:00:00,10.0.0.1,null,1,80,TCP,None,20,1,2,0.5\nnot a time,10.0.0.1,x,1,80,TCP,5,20,1,2,abc\n"
    )
    raw = flows.scan_flow_csv(spark, str(tmp_path / "flow.csv"))
    assert dict(raw.dtypes)["bytes_in"] == "bigint" and dict(raw.dtypes)["duration"] == "double"
    rows = clean.clean_flows(raw, "a test salt").collect()
    assert len(rows) == 1 and rows[0]["src_ip_hash"].startswith("ip_")
    (tmp_path / "window.csv").write_text(
        "src_ip_anon,dst_ip_anon,src_flow_bytes,dst_flow_bytes,src_flow_packets,dst_flow_packets,duration_seconds,timestamp\n"
        "ip_a,ip_b,100,50,3,2,1.5,2024-01-01T00:00:00+00:00\n"
    )
    r = clean.clean_flows(flows.scan_flow_csv(spark, str(tmp_path / "window.csv")), "a test salt").first()
    assert (r["src_ip"], r["bytes_in"], r["bytes_out"], r["packets_in"], r["packets_out"], r["duration"]) == ("ip_a", 100, 50, 3, 2, 1.5)
    assert r["src_ip_hash"] == "ip_a"


def test_training_csvs_skip_incomplete_files(spark, tmp_path):
    line = "2024-01-01 00:00:00,10.0.0.1,10.0.0.2,1,80,TCP,{},20,1,2,0.5\n"
    (tmp_path / "a.csv").write_text(HEADER + "\n" + line.format(10) + line.format(-1) + line.format(""))
    moved = schemas.FLOW_COLUMNS[::-1]
    values = dict(zip(schemas.FLOW_COLUMNS, line.format(30).strip().split(",")))
    (tmp_path / "b.csv").write_text(",".join(moved) + "\n" + ",".join(values[c] for c in moved) + "\n")
    (tmp_path / "c.csv").write_text("timestamp,src_ip\n2024-01-01,1.1.1.1\n")
    (tmp_path / "d.txt").write_text("ignored")
    assert sorted(r["bytes_in"] for r in flows.scan_training_csvs(spark, str(tmp_path)).collect()) == [10, 30]
    with pytest.raises(ValueError):
        flows.scan_training_csvs(spark, str(tmp_path), required=["no_such_column"])


def test_frames(spark, tmp_path):
    good = {"src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "src_port": 5, "dst_port": 80, "protocol": "tcp", "bytes_in": 9, "bytes_out": 8, "duration": 1.5}
    lines = [
        json.dumps({**good, "payload": base64.b64encode(b"hi").decode()}), "", "   ", json.dumps({"payload": None}), "{broken", "[1]",
        json.dumps({**good, "bytes_in": "many"}), json.dumps({**good, "pad": "x" * 9000}), json.dumps({**good, "payload": "*"}),
    ]
    (tmp_path / "f.json").write_text("\n".join(lines))
    rows = flows.scan_flow_frames(spark, str(tmp_path / "f.json")).collect()
    assert len(rows) == 3
    full = next(r for r in rows if r["payload"] is not None)
    assert (bytes(full["payload"]), full["protocol"], full["duration"]) == (b"hi", "TCP", 1.5)
    empty = next(r for r in rows if r["src_ip"] == "")
    assert (empty["src_port"], empty["protocol"], empty["bytes_in"], empty["duration"]) == (0, "OTHER", 0, 0.0)


def test_intrusion_csv(spark, tmp_path):
    values = ["1"] * 43
    values[1], values[2], values[3], values[41], values[4] = "tcp", "http", "SF", "neptune", "?"
    (tmp_path / "k.csv").write_text(",".join(values) + "\n")
    r = flows.scan_intrusion_csv(spark, str(tmp_path / "k.csv")).first()
    assert (r["protocol_type"], r["label"], r["src_bytes"], r["dst_bytes"]) == ("tcp", "neptune", None, 1.0)
    out = clean.intrusion_features_full(clean.label_attacks(flows.scan_intrusion_csv(spark, str(tmp_path / "k.csv")))).first()
    assert (out["attack_category"], out["is_attack"], out["packet_count"], out["protocol_type_TCP"]) == ("DoS", 1, 1, 1)


def test_window_csv_rotates_files(spark, tmp_path):
    rows = spark.range(25).select(
        *[
            F.lit("2024-01-01").cast("timestamp").alias(c) if c in ("timestamp", "window_start", "window_end")
            else (F.lit(1.23456) if c in ("rate_pps", "rate_bps") else F.col("id")).alias(c)
            for c in schemas.WINDOW_COLUMNS
        ]
    )
    path = str(tmp_path / "out")
    sinks.sink_window_csv(rows.coalesce(1), path, rows_per_file=10)
    files = glob.glob(f"{path}/*.csv")
    assert sorted(sum(1 for _ in open(f)) - 1 for f in files) == [5, 10, 10]
    head = open(files[0]).read().splitlines()
    assert head[0].split(",") == schemas.WINDOW_COLUMNS
    assert "2024-01-01T00:00:00.000000+00:00" in head[1] and ",1.23," in head[1]
