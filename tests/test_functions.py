"""Scalar rules against Python's own implementations and hand cases."""

import hashlib
import hmac
import ipaddress
import struct

import pytest
from pyspark.sql import functions as F

from flowlake.functions import encode, ip, payload, scrub

LITERALS = [
    "1.2.3.4", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.04", "", " 1.2.3.4", "a.b.c.d",
    "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:db8:0:0:0:0:0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":1", "1:", ":::", "12345::", "g::", "fe80::1%eth0", "fe80::1%", "%eth0",
    "::ffff:1.2.3.4", "::ffff:1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4", "1.2.3.4::", "64:ff9b::192.0.2.33",
    "fe80::1%a%b", "1:2:3:4:5:6:7:8%x", "0:0:0:0:0:0:0:0", "::0:0", "abcd:ef01:2345:6789:abcd:ef01:2345:6789",
]


def _valid(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_valid_and_packed_match_the_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in LITERALS], "t string")
    rows = df.select("t", ip.valid_ip(F.col("t")).alias("ok"), ip.packed_ip(F.col("t")).alias("p")).collect()
    for r in rows:
        want = _valid(r["t"])
        assert r["ok"] == (want is not None), r["t"]
        assert (bytes(r["p"]) if r["p"] is not None else None) == (want.packed if want else None), r["t"]


def test_hash_matches_hmac_and_depends_on_salt(spark):
    good = [t for t in LITERALS if _valid(t)]
    df = spark.createDataFrame([(t,) for t in good], "t string")
    for salt in ("salt-one", "another salt"):
        for r in df.select("t", ip.hash_ip(F.col("t"), salt).alias("h")).collect():
            digest = hmac.new(salt.encode(), _valid(r["t"]).packed, hashlib.sha256).hexdigest()
            assert r["h"] == "ip_" + digest[:32]


def test_hash_rejects_short_salt_and_bad_address(spark):
    with pytest.raises(ValueError):
        ip.hash_ip(F.lit("1.2.3.4"), "short")
    with pytest.raises(Exception, match="not an IP address"):
        spark.range(1).select(ip.hash_ip(F.lit("nope"), "long enough")).collect()


def test_lenient_hash_passes_unknown_through(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("ip_abc",), (None,)], "t string")
    out = [r[0] for r in df.select(ip.hash_ip_lenient(F.col("t"), "long enough")).collect()]
    assert out[0].startswith("ip_") and len(out[0]) == 35
    assert out[1:] == ["ip_abc", ""]


def test_number_to_ipv4_round_trip(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("10.0.0.1",)], "t string")
    rows = df.select("t", ip.number_to_ipv4(ip.ipv4_to_number(F.col("t"))).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in rows)


def test_round_epoch_floor_and_nearest_even(spark):
    df = spark.createDataFrame([(59.9,), (60.0,), (90.0,), (150.0,), (-1.0,)], "x double")
    rows = df.select(encode.round_epoch(F.col("x"), 60).alias("f"), encode.round_epoch(F.col("x"), 60, "nearest").alias("n")).collect()
    assert [r["f"] for r in rows] == [0, 60, 60, 120, -60]
    assert [r["n"] for r in rows] == [60, 60, 120, 120, 0]
    with pytest.raises(ValueError):
        encode.round_epoch(F.col("x"), 0)


def test_scrub_text(spark):
    text = "a.b@c.org from 10.0.0.1 ghp_abcdefghijklmnopqrstuv AIza" + "x" * 35 + " 1.2.3.4567"
    out = spark.range(1).select(scrub.scrub_text(F.lit(text))).first()[0]
    assert out == "[REDACTED_EMAIL] from [REDACTED_IP] [REDACTED_GITHUB_TOKEN] [REDACTED_FIREBASE_API_KEY] 1.2.3.4567"


def test_scrub_record_nested(spark):
    df = spark.sql(
        "SELECT 1 AS id, 'x' AS Password, named_struct('auth', 'k', 'list', array(named_struct('note', 'me@x.org'))) AS s, "
        "map('API_KEY', 'v', 'other', '1.2.3.4') AS m"
    )
    r = scrub.scrub_record(df).first()
    assert (r["id"], r["Password"], r["s"]["auth"], r["s"]["list"][0]["note"]) == (1, "[REDACTED]", "[REDACTED]", "[REDACTED_EMAIL]")
    assert r["m"] == {"API_KEY": "[REDACTED]", "other": "[REDACTED_IP]"}


def _frame(ether, body):
    return b"\0" * 12 + struct.pack(">H", ether) + body


def _v4(proto, rest=b"", src="1.2.3.4", dst="5.6.7.8"):
    head = bytes([0x45]) + b"\0" * 8 + bytes([proto]) + b"\0\0" + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed
    return _frame(0x0800, head + rest)


def test_header_fields(spark):
    six = ["::", "::1", "2001:db8::1", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8", "1:0:2:0:3:0:4:0", "fe80::", "0:1:0:0:0:1:0:0", "a:0:0:b:0:0:c:d"]
    frames = [
        (_v4(6, struct.pack(">HHI", 1234, 80, 0)), ("1.2.3.4", "5.6.7.8", 1234, 80, "TCP")),
        (_v4(17, struct.pack(">HHI", 53, 5353, 0)), ("1.2.3.4", "5.6.7.8", 53, 5353, "UDP")),
        (_v4(1, b"\0" * 8), ("1.2.3.4", "5.6.7.8", None, None, "IPv4/1")),
        (_v4(6, b"\0\0"), ("1.2.3.4", "5.6.7.8", None, None, "IPv4/6")),
        (_frame(0x0800, b"short"), ("unknown", "unknown", None, None, "unknown")),
        (_frame(0x0806, b"\0" * 40), ("unknown", "unknown", None, None, "unknown")),
        (b"tiny", None),
    ] + [
        (_frame(0x86DD, b"\0" * 8 + ipaddress.ip_address(a).packed + ipaddress.ip_address("::2").packed), (str(ipaddress.ip_address(a)), "::2", None, None, "IPv6"))
        for a in six
    ]
    df = spark.createDataFrame([(i, bytearray(f)) for i, (f, _) in enumerate(frames)], "i int, f binary")
    for r in df.select("i", payload.header_fields(F.col("f")).alias("h")).collect():
        want = frames[r["i"]][1]
        got = tuple(r["h"])[:5] if r["h"] is not None else None
        assert got == want


def test_payload_vector(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\x00\x33"),), (bytearray(b"\x01" * 200),), (None,)], "p binary")
    rows = [r[0] for r in df.select(payload.payload_vector(F.col("p"), 128)).collect()]
    assert all(len(v) == 128 for v in rows)
    assert rows[0][:4] == pytest.approx([1.0, 0.0, 0.2, 0.0])
    assert sum(rows[1]) == pytest.approx(128 / 255, rel=1e-5)
    assert sum(rows[2]) == 0


def test_identify_app_precedence(spark):
    cases = [
        (22, 443, b"", "SSH"), (1, 443, b"GET", "TLS"), (80, 6881, b"", "HTTP"), (6889, 1, b"", "BitTorrent"),
        (1, 2, b"\x16\x03\x01", "TLS"), (1, 2, b"\x16\x03", "Unknown"), (1, 2, b"GET /", "HTTP"), (None, None, None, "Unknown"),
    ]
    df = spark.createDataFrame([(a, b, bytearray(p) if p is not None else None, w) for a, b, p, w in cases], "a int, b int, p binary, w string")
    for r in df.select("w", encode.identify_app(F.col("a"), F.col("b"), F.col("p")).alias("g")).collect():
        assert r["g"] == r["w"]


def test_policy_and_risk_tiers(spark):
    df = spark.createDataFrame([(96,), (95,), (80,), (79,)], "s int")
    assert [r[0] for r in df.select(encode.policy_tier(F.col("s"))).collect()] == ["Isolate", "Throttle", "Throttle", "Monitor"]
    df = spark.createDataFrame([(-0.95,), (0.7,), (0.35,), (0.34,)], "s double")
    assert [r[0] for r in df.select(encode.risk_level(F.col("s"))).collect()] == ["critical", "high", "medium", "low"]


def test_long_salts_final_newlines_and_infinities(spark):

    salt = "s" * 100
    want = "ip_" + hmac.new(salt.encode(), bytes([10, 0, 0, 1]), hashlib.sha256).hexdigest()[:32]
    row = spark.createDataFrame([("10.0.0.1",)], "a string").select(ip.hash_ip(F.col("a"), salt).alias("h")).first()
    assert row["h"] == want
    odd = spark.createDataFrame([("10.0.0.1\n",), ("::1\n",), ("1:2:3:4:5:6:7:8\n",), ("::ffff:10.0.0.1\n",)], "a string")
    assert odd.filter(ip.valid_ip(F.col("a")) | ip.packed_ip(F.col("a")).isNotNull()).count() == 0

    numbers = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (0.125,), (None,)], "x double")
    got = [r[0] for r in numbers.select(encode.rounded(F.col("x"), 2)).collect()]
    assert got[:2] == [float("inf"), float("-inf")] and got[2] != got[2] and got[3:] == [0.12, None]


def test_address_plans_stay_small(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "a string").select(ip.hash_ip(F.col("a"), "12345678"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 16
