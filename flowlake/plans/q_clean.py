"""Registered queries: sources, projections, cleaning, anonymisation, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import encode, ip, payload, scrub
from flowlake.operators import blocklist, clean, decide, windows
from flowlake.plans import fixtures as fx
from flowlake.plans.registry import register
from flowlake.schemas import FLOW_COLUMNS, INTRUSION_COLUMNS, MODEL_FEATURES, WINDOW_COLUMNS
from flowlake.session import scratch_path
from flowlake.sources import flows as src
from flowlake.sources import sinks
from flowlake.streaming import run

# --------------------------------------------------------------------- sources

_TYPED_DIRTY = """
SELECT CAST("timestamp" AS VARCHAR) AS "timestamp", src_ip, nullif(dst_ip, '') AS dst_ip,
  CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, protocol,
  TRY_CAST(bytes_in AS BIGINT) AS bytes_in, CAST(bytes_out AS BIGINT) AS bytes_out,
  CAST(packets_in AS BIGINT) AS packets_in, CAST(packets_out AS BIGINT) AS packets_out,
  TRY_CAST(duration AS DOUBLE) AS duration FROM v_dirty_flows"""


def _dirty_csv(spark, sf):
    path = scratch_path(spark, "dirty-csv")
    fx.v_dirty_flows(spark, sf).write.option("header", True).csv(path)
    return path


@register("s1_scan_flow_csv", fx.with_views("v_dirty_flows", body=_TYPED_DIRTY))
def s1(spark, sf):
    return src.scan_flow_csv(spark, _dirty_csv(spark, sf), FLOW_COLUMNS)


def _write_broken(rows, bad, path, file_rows=500_000):
    """``rows`` as files of about ``file_rows`` rows, each of which holds a ``bad`` row if there is one at all."""
    count = F.count(F.lit(1))
    files = rows.agg(count).first()[0] // file_rows + 1
    hashed = F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int")
    holds = sorted(r["b"] for r in rows.filter(bad).select(hashed.alias("b")).distinct().collect())  # numbers of files
    spread = F.when(hashed.isin(holds), hashed).otherwise(holds[0]) if holds else hashed
    # a file has whole buckets, so none is without a bad row
    rows.withColumn("_bucket", spread).repartition(files, "_bucket").drop("_bucket").write.mode("append").option("header", True).csv(path)


@register("s1_skip_malformed_files", fx.with_views("v_dirty_flows", body=_TYPED_DIRTY))
def s1_skip(spark, sf):
    """Clean files next to files with a broken number, which are left out."""
    path = _dirty_csv(spark, sf)
    broken = fx.v_dirty_flows(spark, sf).withColumn("bytes_out", F.when(F.col("protocol") == "TCP", "many").otherwise(F.col("bytes_out")))
    _write_broken(broken, F.col("bytes_out") == "many", path)
    return src.scan_flow_csv(spark, path, FLOW_COLUMNS, malformed="skip_file")


@register("s2_stream_flow_csv", fx.with_views("v_dirty_flows", body=_TYPED_DIRTY))
def s2(spark, sf):
    return run.drain(src.stream_flow_csv(spark, _dirty_csv(spark, sf)), "stream-csv")


@register(
    "s3_scan_training_csvs",
    fx.with_views("v_flows", body="SELECT * FROM v_flows WHERE bytes_in >= 0 AND bytes_out >= 0"),
)
def s3(spark, sf):
    """One folder with complete files and files that lack a required column."""
    path = scratch_path(spark, "training-csv")
    good = fx.v_flows(spark, sf).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    good.write.option("header", True).csv(f"{path}/complete")
    good.drop("duration").write.option("header", True).csv(f"{path}/incomplete")
    return src.scan_training_csvs(spark, path)


def _frame_lines(spark, sf):
    """JSON frames with missing fields, undecodable payloads, blank and broken lines."""
    p = fx.v_packets(spark, sf)
    encoded = F.when(F.col("packet_id") % 13 == 0, "*").otherwise(F.base64(F.col("payload").cast("binary")))
    body = F.to_json(
        F.struct(
            "src_ip", "dst_ip", "src_port", "dst_port",
            F.when(F.col("packet_id") % 5 != 0, F.lower("protocol")).alias("protocol"),
            F.col("packet_size").alias("bytes_in"), F.lit(0).alias("bytes_out"),
            F.when(F.col("packet_id") % 7 != 0, (F.col("packet_id") % 100) / 4.0).alias("duration"),
            encoded.alias("payload"),
        )
    )
    line = (
        F.when(F.col("packet_id") % 17 == 0, F.lit("  "))
        .when(F.col("packet_id") % 19 == 0, F.substring("b", 1, 20))
        .when(F.col("packet_id") % 23 == 0, F.concat(F.lit("{"), F.repeat(F.lit(" "), 9000), F.expr("substring(b, 2)")))
    )
    return p.select("packet_id", body.alias("b")).withColumn("value", F.coalesce(line, F.col("b"))).select("value")


_FRAMES = fx.with_views(
    "v_packets",
    body="""SELECT src_ip, dst_ip, src_port, dst_port,
  CASE WHEN packet_id % 5 <> 0 THEN protocol ELSE 'OTHER' END AS protocol,
  packet_size AS bytes_in, CAST(0 AS BIGINT) AS bytes_out,
  CASE WHEN packet_id % 7 <> 0 THEN CAST(packet_id % 100 AS DOUBLE) / 4.0 ELSE 0.0 END AS duration,
  CASE WHEN packet_id % 13 <> 0 THEN payload END AS payload
FROM v_packets WHERE packet_id % 17 <> 0 AND packet_id % 19 <> 0 AND packet_id % 23 <> 0""",
)


def _frames_path(spark, sf):
    path = scratch_path(spark, "frames")
    _frame_lines(spark, sf).write.text(path)
    return path


def _decoded(frames):
    return frames.withColumn("payload", F.decode("payload", "UTF-8"))


@register("s4_scan_flow_frames", _FRAMES)
def s4(spark, sf):
    return _decoded(src.scan_flow_frames(spark, _frames_path(spark, sf)))


@register("s4_stream_flow_frames", _FRAMES)
def s4_stream(spark, sf):
    return run.drain(_decoded(src.stream_flow_frames(spark, _frames_path(spark, sf))), "stream-frames")


def labelled_frames(spark, sf):
    """Labelled frames derived from the labelled documents."""
    d = fx.v_labelled(spark, sf)
    return d.select(
        F.concat(F.lit("10.1.0."), (F.col("doc_id") % 256).cast("string")).alias("src_ip"),
        F.lit("192.168.0.1").alias("dst_ip"),
        (F.col("doc_id") % 60000).cast("int").alias("src_port"),
        F.lit(443).alias("dst_port"),
        F.lit("TCP").alias("protocol"),
        F.col("score").cast("long").alias("bytes_in"),
        F.lit(0).cast("long").alias("bytes_out"),
        F.lit(0.5).alias("duration"),
        F.when(F.col("doc_id") % 10 != 0, F.base64(F.col("payload").cast("binary"))).alias("payload"),
        F.when(F.col("y") == 1, "exploit").otherwise("benign").alias("label"),
    )


@register(
    "s5_scan_labelled_frames",
    fx.with_views(
        "v_labelled",
        body="""SELECT '10.1.0.' || (doc_id % 256) AS src_ip, CAST(score AS BIGINT) AS bytes_in,
  CASE WHEN doc_id % 10 <> 0 THEN payload END AS payload, CASE WHEN y = 1 THEN 'exploit' ELSE 'benign' END AS label
FROM v_labelled""",
    ),
)
def s5(spark, sf):
    path = scratch_path(spark, "labelled")
    labelled_frames(spark, sf).write.json(path)
    frames = src.scan_labelled_frames(spark, path)
    return frames.select("src_ip", "bytes_in", F.decode(F.unbase64("payload"), "UTF-8").alias("payload"), "label")


def intrusion_rows(spark, sf):
    """Benchmark-shaped rows: 43 columns of text, some missing."""
    f = fx.v_flows(spark, sf)
    key = F.col("src_port") - 1024
    label = (
        F.when(key % 10 == 0, "neptune").when(key % 10 == 1, "satan").when(key % 10 == 2, "guess_passwd")
        .when(key % 10 == 3, "rootkit").when(key % 10 == 4, "mailbomb").otherwise("normal")
    )
    known = {
        "duration": F.floor("duration"),
        "protocol_type": F.lower("protocol"),
        "service": F.concat(F.lit("svc"), F.col("packets_out").cast("string")),
        "flag": F.lit("SF"),
        "src_bytes": F.when(key % 31 == 0, "?").otherwise(F.col("bytes_in").cast("string")),
        "dst_bytes": F.col("bytes_out"),
        "count": F.col("packets_in"),
        "label": label,
        "difficulty": key % 21,
    }
    return f.select(
        *[known.get(c, key % (i + 2)).cast("string").alias(c) for i, c in enumerate(INTRUSION_COLUMNS)]
    )


_INTRUSION_VIEW = """v_intrusion AS (SELECT CAST(floor(duration) AS DOUBLE) AS duration, lower(protocol) AS protocol_type,
  'svc' || packets_out AS service,
  CASE WHEN (src_port - 1024) % 31 <> 0 THEN CAST(bytes_in AS DOUBLE) END AS src_bytes,
  CAST(bytes_out AS DOUBLE) AS dst_bytes, CAST(packets_in AS DOUBLE) AS n,
  CASE (src_port - 1024) % 10 WHEN 0 THEN 'neptune' WHEN 1 THEN 'satan' WHEN 2 THEN 'guess_passwd'
       WHEN 3 THEN 'rootkit' WHEN 4 THEN 'mailbomb' ELSE 'normal' END AS label,
  CAST((src_port - 1024) % 21 AS DOUBLE) AS difficulty FROM v_flows)"""


def with_intrusion(body: str) -> str:
    return fx.with_views("v_flows", body="") + ", " + _INTRUSION_VIEW + "\n" + body


@register(
    "s6_scan_intrusion_csv",
    with_intrusion('SELECT duration, protocol_type, service, src_bytes, dst_bytes, n AS "count", label, difficulty FROM v_intrusion'),
)
def s6(spark, sf):
    path = scratch_path(spark, "intrusion")
    intrusion_rows(spark, sf).write.option("header", False).csv(path)
    columns = ["duration", "protocol_type", "service", "src_bytes", "dst_bytes", "count", "label", "difficulty"]
    return src.scan_intrusion_csv(spark, path).select(*columns)


@register(
    "s7_ingest_packets",
    fx.with_views("v_packets", body="SELECT packet_id, ts, src_ip, dst_port, packet_size FROM v_packets"),
)
def s7(spark, sf):
    path = scratch_path(spark, "packets")
    fx.v_packets(spark, sf).withColumnRenamed("payload", "raw").withColumns(
        {"raw_data": F.col("raw").cast("binary"), "interface": F.lit("eth0")}
    ).drop("raw").write.parquet(path)
    return src.ingest_packets(spark, path).select("packet_id", "ts", "src_ip", "dst_port", "packet_size")



def sql_hmac(address: str) -> str:
    """The keyed hash of an IPv4 text in the oracle's SQL."""
    return sql_hmac_digits(sql_ipv4_digits(address))


def sql_ipv4_digits(address: str) -> str:
    return " || ".join(
        f"lpad(to_hex(TRY_CAST(split_part({address}, '.', {i}) AS INTEGER)), 2, '0')" for i in range(1, 5)
    )


def sql_hmac_digits(digits: str) -> str:
    """The keyed hash of packed address bytes given as hex digits."""
    key = fx.SALT.encode().ljust(64, b"\0")
    inner = "".join(f"{b ^ 0x36:02X}" for b in key)
    outer = "".join(f"{b ^ 0x5C:02X}" for b in key)
    return (
        f"'ip_' || substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || unhex({digits})))), 1, 32)"
    )


FLOW_ROWS_SQL = f"""
, p AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM v_packets)
, g2 AS (SELECT w, src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS n, CAST(sum(packet_size) AS BIGINT) AS b
    FROM p GROUP BY ALL)
, g1 AS (SELECT w, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b, count(*) AS flows FROM g2 GROUP BY w)
SELECT a.w + INTERVAL 5 MINUTE AS "timestamp", a.w AS window_start, a.w + INTERVAL 5 MINUTE AS window_end,
  CAST(300 AS DOUBLE) AS duration_seconds, g1.n AS packet_count, g1.b AS byte_count, g1.flows AS unique_flows,
  round(g1.n / 300.0, 2) AS rate_pps, round(g1.b * 8 / 300.0, 2) AS rate_bps,
  {sql_hmac('a.src_ip')} AS src_ip_anon, {sql_hmac('a.dst_ip')} AS dst_ip_anon, a.protocol,
  a.src_port, a.dst_port, a.n AS src_flow_packets, a.b AS src_flow_bytes,
  coalesce(r.n, 0) AS dst_flow_packets, coalesce(r.b, 0) AS dst_flow_bytes
FROM g2 a JOIN g1 ON a.w = g1.w LEFT JOIN g2 r ON r.w = a.w AND r.src_ip = a.dst_ip AND r.dst_ip = a.src_ip
  AND r.src_port = a.dst_port AND r.dst_port = a.src_port AND r.protocol = a.protocol
  AND NOT (a.src_ip = a.dst_ip AND a.src_port = a.dst_port)"""


def two_way_packets(spark, sf):
    """Packets and, for the TCP ones, a reply a second later."""
    p = fx.v_packets(spark, sf)
    back = p.filter("protocol = 'TCP'").select(
        (F.col("packet_id") + 1_000_000_000).alias("packet_id"),
        F.timestamp_micros(F.unix_micros("ts") + 1_000_000).alias("ts"),
        F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"),
        F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port"),
        "protocol", (F.col("packet_size") * 2).alias("packet_size"), "payload",
    )
    return p.unionByName(back)


TWO_WAY_VIEW = fx.with_views("v_scores", body="") + """, v_packets AS (
  SELECT packet_id, ts, src_ip, dst_ip, src_port, dst_port, protocol, packet_size FROM v_scores
  UNION ALL SELECT packet_id + 1000000000, ts + INTERVAL 1 SECOND, dst_ip, src_ip, dst_port, src_port, protocol,
  packet_size * 2 FROM v_scores WHERE protocol = 'TCP')"""


@register("g4_flow_rows", TWO_WAY_VIEW + FLOW_ROWS_SQL)
def g4(spark, sf):
    return windows.flow_rows(two_way_packets(spark, sf), fx.SALT, 300)


@register("s8_sink_window_csv", TWO_WAY_VIEW + FLOW_ROWS_SQL)
def s8(spark, sf):
    """Round trip through the CSV sink: written rows, read back with their types."""
    path = scratch_path(spark, "window-csv")
    sinks.sink_window_csv(windows.flow_rows(two_way_packets(spark, sf), fx.SALT, 300), path)
    back = src.scan_flow_csv(spark, path, WINDOW_COLUMNS)
    return back.withColumns(
        {
            **{c: F.col(c).cast("timestamp") for c in ("timestamp", "window_start", "window_end")},
            "unique_flows": F.col("unique_flows").cast("long"),
        }
    )


@register(
    "s9_export_blocklist_json",
    fx.with_views(
        "v_blocklist",
        body="""SELECT count(*) OVER () AS total_entries, count(*) FILTER (WHERE is_active) OVER () AS active_entries,
  row_number() OVER (ORDER BY created_at DESC, ip_address, source) - 1 AS place, ip_address, source, risk_level, is_active, hit_count,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at, strftime(expires_at, '%Y-%m-%dT%H:%M:%S.000Z') AS expires_at, true AS has_expiry_field
FROM (SELECT * FROM v_blocklist ORDER BY created_at DESC, ip_address, source LIMIT 10000)""",
    ),
)
def s9(spark, sf):
    """The document's entries, read back from its text."""
    doc = blocklist.export_json(fx.v_blocklist(spark, sf), fx.as_of())
    texts = F.from_json(F.get_json_object("document", "$.entries"), "array<string>")
    entry = doc.select("total_entries", "active_entries", F.posexplode(texts).alias("place", "e"))
    field = lambda name, kind="string": F.get_json_object("e", f"$.{name}").cast(kind).alias(name)
    return entry.select(
        "total_entries", "active_entries", F.col("place").cast("long").alias("place"), *map(field, ("ip_address", "source", "risk_level")),
        field("is_active", "boolean"), field("hit_count", "long"), field("created_at"), field("expires_at"),
        F.array_contains(F.json_object_keys("e"), "expires_at").alias("has_expiry_field"),
    )


APP_SQL = """CASE WHEN src_port = 22 OR dst_port = 22 THEN 'SSH' WHEN src_port = 443 OR dst_port = 443 THEN 'TLS'
  WHEN src_port = 80 OR dst_port = 80 THEN 'HTTP'
  WHEN src_port BETWEEN 6881 AND 6889 OR dst_port BETWEEN 6881 AND 6889 THEN 'BitTorrent' ELSE 'Unknown' END"""
RISK_SQL = "CASE app_id WHEN 'BitTorrent' THEN 96 WHEN 'SSH' THEN 85 WHEN 'HTTP' THEN 50 WHEN 'TLS' THEN 10 ELSE 70 END"
DECISIONS_SQL = f"""
, d0 AS (SELECT *, {APP_SQL} AS app_id FROM v_packets)
, d1 AS (SELECT *, {RISK_SQL} AS confidence_score FROM d0)
, decisions AS (SELECT *, CASE WHEN confidence_score > 95 THEN 'Isolate' WHEN confidence_score >= 80 THEN 'Throttle'
    ELSE 'Monitor' END AS policy_tier,
  CASE WHEN confidence_score > 95 THEN 'Blocking IP ' || src_ip || ' due to high risk app ' || app_id
    WHEN confidence_score >= 80 THEN 'Throttling IP ' || src_ip || ' due to suspicious app ' || app_id
    ELSE 'Monitoring IP ' || src_ip || ' - App ' || app_id END AS action,
  'Detected protocol ' || app_id AS reason FROM d1)"""


@register(
    "s10_publish_security_events",
    fx.with_views("v_packets", body="") + DECISIONS_SQL + """
SELECT src_ip AS key, '{"src_ip":"' || src_ip || '","app_id":"' || app_id || '","confidence_score":' || confidence_score
  || ',"risk_level":"' || policy_tier || '","action":"' || action || '","reason":"' || reason || '"}' AS value
FROM decisions""",
)
def s10(spark, sf):
    """Decisions on the packet stream, one JSON message each, written by a streaming sink."""
    stream = fx.packets_from(fx.stream_table(spark, sf, "events"))
    messages = decide.security_events(decide.policy_decisions(stream))
    path, checkpoint = scratch_path(spark, "events-out"), scratch_path(spark, "events-checkpoint")
    sinks.publish_events(messages, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(messages.schema).json(path)


# ----------------------------------------------------------------- projections


@register(
    "p1_harmonise_schema",
    fx.with_views(
        "v_window_rows",
        body="""SELECT packet_id, src_ip_anon AS src_ip, dst_ip_anon AS dst_ip, duration_seconds AS duration,
  byte_count AS bytes_in, dst_flow_bytes AS bytes_out, packet_count AS packets_in, dst_flow_packets AS packets_out
FROM v_window_rows""",
    ),
)
def p1(spark, sf):
    out = clean.harmonise_schema(fx.v_window_rows(spark, sf))
    return out.select("packet_id", "src_ip", "dst_ip", "duration", "bytes_in", "bytes_out", "packets_in", "packets_out")


@register(
    "p2_drop_incomplete",
    fx.with_views("v_dirty_flows", body="SELECT * REPLACE (CASE WHEN duration <> 'n/a' THEN duration END AS duration) FROM v_dirty_flows WHERE bytes_in <> 'null' AND dst_ip <> ''"),
)
def p2(spark, sf):
    return clean.drop_incomplete(clean.null_texts(fx.v_dirty_flows(spark, sf)))


@register(
    "p3_coerce_numeric",
    fx.with_views(
        "v_dirty_flows",
        body="""SELECT src_ip, CAST(src_port AS DOUBLE) AS src_port, coalesce(TRY_CAST(bytes_in AS DOUBLE), 0) AS bytes_in,
  coalesce(TRY_CAST(duration AS DOUBLE), 0) AS duration FROM v_dirty_flows""",
    ),
)
def p3(spark, sf):
    return clean.coerce_numeric(fx.v_dirty_flows(spark, sf)).select("src_ip", "src_port", "bytes_in", "duration")


@register(
    "p4_coerce_timestamp",
    fx.with_views(
        "v_dirty_flows",
        body="""SELECT CAST("timestamp" AS TIMESTAMP) AS "timestamp", src_ip, src_port FROM v_dirty_flows
WHERE CAST(src_port AS BIGINT) % 29 <> 0""",
    ),
)
def p4(spark, sf):
    broken = F.when(F.col("src_port").cast("long") % 29 == 0, "not a time").otherwise(F.col("timestamp"))
    dirty = fx.v_dirty_flows(spark, sf).withColumn("timestamp", broken)
    return clean.coerce_timestamp(dirty).select("timestamp", "src_ip", "src_port")


@register(
    "p5_training_row_filter",
    fx.with_views("v_dirty_flows", body="SELECT * FROM (" + _TYPED_DIRTY + ") WHERE dst_ip IS NOT NULL AND bytes_in >= 0 AND bytes_out >= 0 AND duration IS NOT NULL"),
)
def p5(spark, sf):
    return clean.training_row_filter(clean.type_flow_columns(clean.null_texts(fx.v_dirty_flows(spark, sf))))


def _mixed_addresses(spark, sf):
    """Addresses of both families, valid and broken, in known proportion."""
    f = fx.v_flows(spark, sf)
    key = F.col("src_port")
    group = F.lower(F.hex("dst_port"))
    text = (
        F.when(key % 6 == 0, F.col("src_ip"))
        .when(key % 6 == 1, F.concat(F.lit("300."), F.col("src_ip")))
        .when(key % 6 == 2, F.concat(F.lit("2001:db8::"), group))
        .when(key % 6 == 3, F.concat(F.lit("2001:db8::"), group, F.lit("::1")))
        .when(key % 6 == 4, F.concat(F.lit("::ffff:"), F.col("src_ip")))
        .otherwise(F.lit("unknown"))
    )
    return f.select("src_port", text.alias("address"))


_MIXED = """SELECT src_port, CASE src_port % 6 WHEN 0 THEN src_ip WHEN 1 THEN '300.' || src_ip
  WHEN 2 THEN '2001:db8::' || lower(to_hex(dst_port)) WHEN 3 THEN '2001:db8::' || lower(to_hex(dst_port)) || '::1'
  WHEN 4 THEN '::ffff:' || src_ip ELSE 'unknown' END AS address"""


@register("p6_valid_ip", fx.with_views("v_flows", body=_MIXED + ", src_port % 6 IN (0, 2, 4) AS is_valid FROM v_flows"))
def p6(spark, sf):
    return _mixed_addresses(spark, sf).withColumn("is_valid", ip.valid_ip(F.col("address")))


@register(
    "p7_protocol_name",
    """SELECT l_orderkey, l_linenumber, CASE (l_linenumber * 5 + 1) % 18 WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP'
  ELSE 'OTHER' END AS protocol FROM lineitem""",
)
def p7(spark, sf):
    t = fx.table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", encode.protocol_name((F.col("l_linenumber") * 5 + 1) % 18).alias("protocol"))


@register(
    "p8_header_fields",
    fx.with_views(
        "v_packets",
        body="""SELECT packet_id, src_ip, dst_ip, CASE WHEN protocol <> 'ICMP' THEN src_port END AS src_port,
  CASE WHEN protocol <> 'ICMP' THEN dst_port END AS dst_port,
  CASE WHEN protocol = 'ICMP' THEN 'IPv4/1' ELSE protocol END AS protocol FROM v_packets""",
    ),
)
def p8(spark, sf):
    """Frames assembled from the packet columns and decoded again."""
    p = fx.v_packets(spark, sf)

    def hexed(value, width):
        return F.lpad(F.hex(value.cast("long")), width, "0")

    number = F.when(F.col("protocol") == "TCP", 6).when(F.col("protocol") == "UDP", 17).otherwise(1)
    digits = F.concat(
        F.lit("00" * 12 + "0800" + "4500" + "0000" * 3 + "40"), hexed(number, 2), F.lit("0000"),
        hexed(ip.ipv4_to_number(F.col("src_ip")), 8), hexed(ip.ipv4_to_number(F.col("dst_ip")), 8),
        hexed(F.col("src_port"), 4), hexed(F.col("dst_port"), 4), F.lit("00000000"),
    )
    return p.select("packet_id", payload.header_fields(F.unhex(digits)).alias("h")).select("packet_id", "h.*").drop("packet_size")


@register(
    "p9_encode_protocol",
    fx.with_views(
        "v_packets",
        body="""SELECT packet_id, CASE protocol WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 WHEN 'ICMP' THEN 3 END AS training,
  CASE protocol WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 WHEN 'ICMP' THEN 3 END AS router,
  0 AS serving_unknown, 5 AS training_unknown FROM v_packets""",
    ),
)
def p9(spark, sf):
    proto = F.col("protocol")
    return fx.v_packets(spark, sf).select(
        "packet_id",
        encode.encode_protocol_training(proto).alias("training"),
        encode.encode_protocol_router(F.lower(proto)).alias("router"),
        encode.encode_protocol_serving(F.concat(proto, F.lit("x"))).alias("serving_unknown"),
        encode.encode_protocol_training(F.concat(proto, F.lit("x"))).alias("training_unknown"),
    )


_PREPARED = """SELECT bytes_in, bytes_out, packets_in, packets_out, duration, src_port, dst_port,
  CASE protocol WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 WHEN 'ICMP' THEN 3 ELSE 5 END AS protocol FROM v_flows"""


@register("p10_abs_ports", fx.with_views("v_flows", body="SELECT src_port, dst_port, count(*) AS n FROM v_flows GROUP BY ALL"))
def p10(spark, sf):
    negative = fx.v_flows(spark, sf).withColumn("src_port", -F.col("src_port"))
    out = clean.prepare_features(negative, ["src_port", "dst_port"])
    return out.groupBy("src_port", "dst_port").agg(F.count(F.lit(1)).alias("n"))


@register("p11_require_columns", fx.with_views("v_flows", body="SELECT protocol, count(*) AS n FROM v_flows GROUP BY protocol"))
def p11(spark, sf):
    checked = clean.require_columns(fx.v_flows(spark, sf), FLOW_COLUMNS)
    return checked.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))


@register(
    "p12_temporal_features",
    fx.with_views(
        "v_packets",
        body="""SELECT packet_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  CAST(hour(ts) < 6 AS INTEGER) AS is_night,
  CAST(hour(ts) >= 8 AND hour(ts) < 18 AND isodow(ts) <= 5 AS INTEGER) AS is_business_hours,
  CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:10:00') < 120000000 AS INTEGER) AS in_boot_window FROM v_packets""",
    ),
)
def p12(spark, sf):
    startup = F.lit("2024-01-01 00:10:00").cast("timestamp")
    return fx.v_packets(spark, sf).withColumns(encode.clock_features(F.col("ts"), startup)).select(
        "packet_id", "hour_of_day", "day_of_week", "is_night", "is_business_hours", "in_boot_window"
    )


@register(
    "p13_risk_level",
    fx.with_views(
        "v_scores",
        body="""SELECT packet_id, CASE WHEN abs(if_score) >= 0.9 THEN 'critical' WHEN abs(if_score) >= 0.7 THEN 'high'
  WHEN abs(if_score) >= 0.35 THEN 'medium' ELSE 'low' END AS risk_level FROM v_scores""",
    ),
)
def p13(spark, sf):
    return fx.v_scores(spark, sf).select("packet_id", encode.risk_level(F.col("if_score")).alias("risk_level"))


@register(
    "p14_identify_app",
    fx.with_views("v_packets", body=f"SELECT packet_id, CASE WHEN {APP_SQL} <> 'Unknown' THEN {APP_SQL} WHEN packet_id % 2 = 0 THEN 'HTTP' WHEN packet_id % 3 = 0 THEN 'TLS' ELSE 'Unknown' END AS app_id FROM v_packets"),
)
def p14(spark, sf):
    start = F.when(F.col("packet_id") % 2 == 0, F.lit(b"GET /")).when(F.col("packet_id") % 3 == 0, F.lit(b"\x16\x03\x01")).otherwise(F.lit(b"..."))
    app = encode.identify_app(F.col("src_port"), F.col("dst_port"), start)
    return fx.v_packets(spark, sf).select("packet_id", app.alias("app_id"))


@register("p15_app_risk_score", fx.with_views("v_packets", body="") + DECISIONS_SQL + "SELECT packet_id, app_id, confidence_score FROM decisions")
def p15(spark, sf):
    return decide.policy_decisions(fx.v_packets(spark, sf)).select("packet_id", "app_id", "confidence_score")


@register("p16_policy_tier", fx.with_views("v_packets", body="") + DECISIONS_SQL + "SELECT packet_id, policy_tier, action, reason FROM decisions")
def p16(spark, sf):
    return decide.policy_decisions(fx.v_packets(spark, sf)).select("packet_id", "policy_tier", "action", "reason")


@register(
    "p17_attack_category",
    with_intrusion(
        """SELECT label, CAST(label <> 'normal' AS INTEGER) AS is_attack, CASE label WHEN 'normal' THEN 'Normal' WHEN 'neptune' THEN 'DoS'
  WHEN 'satan' THEN 'Probe' WHEN 'guess_passwd' THEN 'R2L' WHEN 'rootkit' THEN 'U2R' ELSE 'Other' END AS attack_category,
  count(*) AS n FROM v_intrusion GROUP BY ALL"""
    ),
)
def p17(spark, sf):
    out = clean.label_attacks(intrusion_rows(spark, sf))
    return out.groupBy("label", "is_attack", "attack_category").agg(F.count(F.lit(1)).alias("n"))


@register(
    "p18_intrusion_features_min",
    with_intrusion(
        """SELECT n AS packet_count, coalesce(src_bytes, 0) + dst_bytes AS byte_count, duration AS duration_seconds,
  (coalesce(src_bytes, 0) + dst_bytes) / greatest(duration, CAST(0.001 AS DOUBLE)) AS rate_bps,
  CAST(lower(label) <> 'normal' AS INTEGER) AS is_attack FROM v_intrusion"""
    ),
)
def p18(spark, sf):
    out = clean.intrusion_features_min(intrusion_rows(spark, sf))
    return out.select("packet_count", "byte_count", "duration_seconds", "rate_bps", "is_attack")


@register(
    "p19_intrusion_features_full",
    with_intrusion(
        """SELECT CAST(floor(greatest((coalesce(src_bytes, 0) + dst_bytes) / 536.0, 1.0)) AS BIGINT) AS packet_count,
  coalesce(src_bytes, 0) + dst_bytes AS byte_count, greatest(duration, CAST(0.1 AS DOUBLE)) AS duration,
  (coalesce(src_bytes, 0) + dst_bytes) / greatest(duration, CAST(0.1 AS DOUBLE)) AS rate,
  CAST(protocol_type = 'tcp' AS INTEGER) AS "protocol_type_TCP", CAST(protocol_type = 'udp' AS INTEGER) AS "protocol_type_UDP",
  CAST(protocol_type = 'icmp' AS INTEGER) AS "protocol_type_ICMP" FROM v_intrusion"""
    ),
)
def p19(spark, sf):
    out = clean.intrusion_features_full(intrusion_rows(spark, sf))
    return out.select(
        "packet_count", "byte_count", "duration", "rate", "protocol_type_TCP", "protocol_type_UDP", "protocol_type_ICMP"
    )


@register(
    "p20_estimate_packets",
    fx.with_views("v_flows", body="SELECT bytes_in, bytes_out, greatest(CAST(ceil(bytes_in / 1500.0) AS BIGINT), 1) AS packets_in, greatest(CAST(ceil(bytes_out / 1500.0) AS BIGINT), 1) AS packets_out FROM v_flows"),
)
def p20(spark, sf):
    return fx.v_flows(spark, sf).select(
        "bytes_in", "bytes_out",
        encode.estimate_packets(F.col("bytes_in")).alias("packets_in"),
        encode.estimate_packets(F.col("bytes_out")).alias("packets_out"),
    )


@register(
    "p21_payload_vector",
    fx.with_views(
        "v_packets",
        body="""SELECT packet_id, 128 AS width, CAST(list_sum(list_transform(string_split(left(payload, 128), ''), lambda x: ascii(x))) AS BIGINT) AS byte_sum
FROM v_packets""",
    ),
)
def p21(spark, sf):
    vector = payload.payload_vector(F.col("payload").cast("binary"), 128)
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 255).cast("long"))
    return fx.v_packets(spark, sf).select("packet_id", vector.alias("v")).select(
        "packet_id", F.size("v").alias("width"), total.alias("byte_sum")
    )


@register(
    "p22_binary_label",
    fx.with_views("v_labelled", body="SELECT y, count(*) AS n FROM v_labelled WHERE doc_id % 10 <> 0 GROUP BY y"),
)
def p22(spark, sf):
    return clean.binary_payload_label(labelled_frames(spark, sf)).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register(
    "p23_feature_envelope",
    fx.with_views(
        "v_packets",
        body="""SELECT 1 AS schema_version, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS observed_at, 'collector' AS source,
  CAST(packet_size AS VARCHAR) AS size_feature, src_ip AS ip_feature FROM v_packets""",
    ),
)
def p23(spark, sf):
    out = clean.feature_envelope(fx.v_packets(spark, sf), "ts", "collector", ["packet_size", "src_ip"])
    return out.select(
        "schema_version", "observed_at", "source",
        F.col("features")["packet_size"].alias("size_feature"), F.col("features")["src_ip"].alias("ip_feature"),
    )


@register(
    "p24_select_features",
    fx.with_views(
        "v_dirty_flows",
        body="""SELECT coalesce(TRY_CAST(bytes_in AS DOUBLE), 0) AS bytes_in, coalesce(TRY_CAST(bytes_out AS DOUBLE), 0) AS bytes_out,
  CAST(packets_in AS DOUBLE) AS packets_in, CAST(packets_out AS DOUBLE) AS packets_out,
  coalesce(TRY_CAST(duration AS DOUBLE), 0) AS duration, CAST(src_port AS DOUBLE) AS src_port,
  CAST(dst_port AS DOUBLE) AS dst_port, CAST(0 AS DOUBLE) AS protocol FROM v_dirty_flows""",
    ),
)
def p24(spark, sf):
    return clean.select_features(fx.v_dirty_flows(spark, sf), MODEL_FEATURES)


# ---------------------------------------------------------------- anonymisation


@register("a1_hash_ip", fx.with_views("v_flows", body=f"SELECT src_ip, {sql_hmac('src_ip')} AS src_hash, {sql_hmac('dst_ip')} AS dst_hash, count(*) AS n FROM v_flows GROUP BY ALL"))
def a1(spark, sf):
    """Distinct pairs first, so each pair is hashed once."""
    pairs = fx.v_flows(spark, sf).groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select(
        "src_ip", ip.hash_ip(F.col("src_ip"), fx.SALT).alias("src_hash"), ip.hash_ip(F.col("dst_ip"), fx.SALT).alias("dst_hash"), "n"
    )


_MIXED_DIGITS = f"""CASE src_port % 6 WHEN 0 THEN {sql_ipv4_digits('src_ip')}
  WHEN 2 THEN '20010db8' || repeat('0', 20) || lpad(to_hex(dst_port), 4, '0')
  WHEN 4 THEN repeat('0', 20) || 'ffff' || {sql_ipv4_digits('src_ip')} END"""


@register(
    "a2_hash_ip_lenient",
    fx.with_views(
        "v_flows",
        body=f"""SELECT address, CASE WHEN digits IS NULL THEN address ELSE {sql_hmac_digits("digits")} END AS hashed
FROM ({_MIXED} , {_MIXED_DIGITS} AS digits FROM v_flows)""",
    ),
)
def a2(spark, sf):
    return _mixed_addresses(spark, sf).select("address", ip.hash_ip_lenient(F.col("address"), fx.SALT).alias("hashed"))


@register(
    "a3_round_epoch",
    fx.with_views(
        "v_packets",
        body="""SELECT packet_id, CAST(floor(epoch_us(ts) / 1000000.0 / 60.0) AS BIGINT) * 60 AS floored,
  CAST(round_even(epoch_us(ts) / 1000000.0 / 60.0, 0) AS BIGINT) * 60 AS nearest FROM v_packets""",
    ),
)
def a3(spark, sf):
    seconds = encode.epoch_seconds(F.col("ts"))
    return fx.v_packets(spark, sf).select(
        "packet_id", encode.round_epoch(seconds, 60).alias("floored"), encode.round_epoch(seconds, 60, "nearest").alias("nearest")
    )


@register("a4_round_datetime", fx.with_views("v_packets", body="SELECT packet_id, date_trunc('minute', ts) AS rounded FROM v_packets"))
def a4(spark, sf):
    return fx.v_packets(spark, sf).select("packet_id", encode.round_timestamp(F.col("ts"), 60).alias("rounded"))


@register(
    "a5_scrub_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g'),
  '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b', '[REDACTED_IP]', 'g'),
  '\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b', '[REDACTED_GITHUB_TOKEN]', 'g'),
  '\bAIza[0-9A-Za-z\-_]{30,}\b', '[REDACTED_FIREBASE_API_KEY]', 'g') AS text FROM documents""",
)
def a5(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", scrub.scrub_text(F.col("text")).alias("text"))


@register(
    "a6_scrub_record",
    """SELECT event_id, '[REDACTED]' AS ip, '[REDACTED]' AS user_email, 'at [REDACTED_IP]' AS user_note,
  'mail [REDACTED_EMAIL]' AS first_tag, '[REDACTED]' AS map_token, event_type AS map_kind FROM events""",
)
def a6(spark, sf):
    e = fx.table(spark, sf, "events")
    address = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    nested = e.select(
        "event_id", address.alias("ip"),
        F.struct(
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("Email"),
            F.concat(F.lit("at "), address).alias("note"),
        ).alias("user"),
        F.array(F.concat(F.lit("mail u"), F.col("user_id").cast("string"), F.lit("@example.org"))).alias("tags"),
        F.create_map(F.lit("Token"), F.col("props"), F.lit("kind"), F.col("event_type")).alias("extra"),
    )
    out = scrub.scrub_record(nested)
    return out.select(
        "event_id", "ip", F.col("user.Email").alias("user_email"), F.col("user.note").alias("user_note"),
        F.col("tags")[0].alias("first_tag"), F.col("extra")["Token"].alias("map_token"), F.col("extra")["kind"].alias("map_kind"),
    )


# --------------------------------------------------------------- set operations


@register("u1_combine_flows", fx.with_views("v_flows", body="SELECT protocol, count(*) * 2 AS n, CAST(sum(bytes_in) * 2 AS BIGINT) AS bytes_in FROM v_flows GROUP BY protocol"))
def u1(spark, sf):
    flows = fx.v_flows(spark, sf)
    return clean.combine_flows([flows, flows]).groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_in").alias("bytes_in"))


@register("u2_dedup_flows", fx.with_views("v_flows", body="SELECT DISTINCT * FROM v_flows"))
def u2(spark, sf):
    flows = fx.v_flows(spark, sf)
    return clean.dedup_flows(clean.combine_flows([flows, flows.filter("protocol = 'TCP'")]))


@register(
    "u2_dedup_report",
    fx.with_views(
        "v_flows",
        body="""SELECT CAST(sum(n) AS BIGINT) AS initial_rows, count(*) AS final_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates_removed FROM
(SELECT count(*) AS n FROM (SELECT * FROM v_flows UNION ALL SELECT * FROM v_flows WHERE protocol = 'TCP') t
 GROUP BY ALL, "timestamp", src_ip, dst_ip, src_port, dst_port, protocol, bytes_in, bytes_out, packets_in, packets_out, duration)""".replace("GROUP BY ALL, ", "GROUP BY "),
    ),
)
def u2_report(spark, sf):
    flows = fx.v_flows(spark, sf)
    return clean.dedup_report(clean.combine_flows([flows, flows.filter("protocol = 'TCP'")]))


@register("u3_union_splits", with_intrusion("SELECT label, count(*) AS n FROM v_intrusion GROUP BY label"))
def u3(spark, sf):
    rows = intrusion_rows(spark, sf)
    odd = F.col("difficulty").cast("int") % 2 == 1
    whole = rows.filter(odd).unionByName(rows.filter(~odd))
    return whole.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
