"""Registered queries: window statistics, per-source sequences, health, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import audit, behaviour, decide, health, metrics, police, windows
from flowlake.operators.sequence import POSITION, ordered
from flowlake.plans import fixtures as fx
from flowlake.plans.q_clean import DECISIONS_SQL, sql_hmac
from flowlake.plans.registry import register
from flowlake.session import scratch_path
from flowlake.streaming import run, stateful
from flowlake.streaming import windows as stream_windows

# --------------------------------------------------------------------- windows

_G1 = """SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, CAST(300 AS DOUBLE) AS duration_seconds,
  count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS byte_count,
  count(DISTINCT (src_ip, dst_ip, src_port, dst_port, protocol)) AS unique_flows,
  round(count(*) / 300.0, 2) AS rate_pps, round(sum(packet_size) * 8 / 300.0, 2) AS rate_bps
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM v_packets) GROUP BY w"""


@register("g1_window_stats", fx.with_views("v_packets", body=_G1))
def g1(spark, sf):
    return windows.window_stats(fx.v_packets(spark, sf), 300)


@register(
    "g2_flow_stats",
    fx.with_views(
        "v_packets",
        body=f"""SELECT w AS window_start, {sql_hmac('src_ip')} AS src_ip_anon, {sql_hmac('dst_ip')} AS dst_ip_anon,
  src_port, dst_port, protocol, n AS packet_count, b AS byte_count, first_seen, last_seen,
  (epoch_us(last_seen) - epoch_us(first_seen)) / CAST(1000000 AS DOUBLE) AS duration_seconds,
  b / CAST(n AS DOUBLE) AS avg_packet_size FROM (
  SELECT time_bucket(INTERVAL 6 HOUR, ts) AS w, src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS n,
    CAST(sum(packet_size) AS BIGINT) AS b, min(ts) AS first_seen, max(ts) AS last_seen FROM v_packets GROUP BY ALL)""",
    ),
)
def g2(spark, sf):
    return windows.flow_stats(fx.v_packets(spark, sf), fx.SALT, 21600)


@register(
    "g3_protocol_counts",
    fx.with_views(
        "v_packets",
        body="""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, nullif(count(*) FILTER (WHERE protocol = 'TCP'), 0) AS tcp,
  nullif(count(*) FILTER (WHERE protocol = 'UDP'), 0) AS udp, nullif(count(*) FILTER (WHERE protocol = 'ICMP'), 0) AS icmp
FROM v_packets GROUP BY 1""",
    ),
)
def g3(spark, sf):
    counts = windows.protocol_counts(fx.v_packets(spark, sf), 3600)
    return counts.select(
        "window_start", *[F.col("protocol_counts")[p].alias(p.lower()) for p in ("TCP", "UDP", "ICMP")]
    )


@register(
    "g5_traffic_counters",
    fx.with_views(
        "v_packets",
        body="""SELECT CAST(sum(n) AS BIGINT) AS packets_processed, CAST(sum(b) AS BIGINT) AS bytes_processed,
  count(DISTINCT w) AS windows_completed, count(*) AS flows_tracked FROM (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS n,
    sum(packet_size) AS b FROM v_packets GROUP BY ALL)""",
    ),
)
def g5(spark, sf):
    return windows.traffic_counters(fx.v_packets(spark, sf), 300)


@register(
    "g16_counter_totals",
    """SELECT count(*) FILTER (WHERE event_type <> 'error') AS passed, count(*) FILTER (WHERE event_type = 'error') AS dropped,
  CAST(sum(64 + CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events""",
)
def g16(spark, sf):
    """Per-worker partial counters (one worker per user) summed to totals."""
    e = fx.table(spark, sf, "events")
    partial = e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("passed"),
        F.count_if(F.col("event_type") == "error").alias("dropped"),
        F.sum((64 + F.floor("value")).cast("long")).alias("bytes"),
    )
    return windows.counter_totals(partial)


# ------------------------------------------------------------ per-source rhythm

HISTORY_SQL = """
, gaps AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER s, 0) AS gap_us FROM v_scores
    WINDOW s AS (PARTITION BY src_ip ORDER BY ts, packet_id))
, hist AS (SELECT *, avg(if_score) OVER h AS mean_score, count(*) OVER h AS gaps_n, sum(gap_us) OVER h AS gap_sum,
    stddev_samp(gap_us) OVER h AS gap_dev, row_number() OVER (PARTITION BY src_ip ORDER BY ts, packet_id) AS pos
  FROM gaps WINDOW h AS (PARTITION BY src_ip ORDER BY ts, packet_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
, history AS (SELECT *, gap_us / CAST(1000000 AS DOUBLE) AS interval_raw,
    CASE WHEN gaps_n >= 2 THEN CAST(gap_sum AS DOUBLE) / (gaps_n * CAST(1000000 AS DOUBLE)) END AS mean_interval,
    round(if_score - mean_score, 10) AS ip_score_delta, least(pos, 1000) AS ip_flow_count,
    CAST(gap_us / 1000000.0 < 0.1 AS INTEGER) AS is_burst, CAST(gap_us / 1000000.0 > 30 AS INTEGER) AS is_slow,
    CASE WHEN gaps_n >= 5 AND gap_sum > 0 AND gap_dev / (gap_sum / gaps_n) < 0.25 THEN 1 ELSE 0 END AS is_periodic
  FROM hist)"""


def _history(spark, sf):
    return behaviour.source_history(fx.v_scores(spark, sf))


def _history_query(name: str, columns: str):
    wanted = [c.split(" AS ")[-1].strip() for c in columns.split(",")]

    @register(name, fx.with_views("v_scores", body="") + HISTORY_SQL + f" SELECT packet_id, {columns} FROM history")
    def query(spark, sf):
        out = _history(spark, sf).withColumns(
            {c: F.round(c, 10) for c in ("mean_score", "ip_score_delta")}
        )
        return out.select("packet_id", *wanted)

    return query


_history_query("w1_inter_arrival", "interval_raw")
_history_query("w3_rolling_mean_interval", "mean_interval")
_history_query("w4_score_delta", "ip_score_delta")
_history_query("w6_flow_count", "ip_flow_count")
_history_query("w7_is_periodic", "is_periodic")


@register("w2_rolling_mean_score", fx.with_views("v_scores", body="") + HISTORY_SQL + " SELECT packet_id, round(mean_score, 10) AS mean_score FROM history")
def w2(spark, sf):
    return _history(spark, sf).select("packet_id", F.round("mean_score", 10).alias("mean_score"))


_DELTA = "CASE WHEN mean_interval > 0 THEN interval_raw - mean_interval ELSE 0.0 END AS interval_delta"


@register("w5_interval_delta", fx.with_views("v_scores", body="") + HISTORY_SQL + f" SELECT packet_id, {_DELTA}, is_burst, is_slow FROM history")
def w5(spark, sf):
    return _history(spark, sf).select("packet_id", "interval_delta", "is_burst", "is_slow")


def _beacon_sql(keys: str) -> str:
    return f"""
, g AS (SELECT *, epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) OVER (PARTITION BY {keys} ORDER BY ts, packet_id) AS gap FROM v_packets)
, b AS (SELECT packet_id, count(*) OVER (PARTITION BY {keys} ORDER BY ts, packet_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n_timestamps,
    var_samp(gap) OVER (PARTITION BY {keys} ORDER BY ts, packet_id ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS gap_variance FROM g)
SELECT packet_id, n_timestamps, gap_variance < 5e13 AS is_beacon, round(sqrt(gap_variance) / 1e9, 1) AS jitter_seconds FROM b WHERE n_timestamps >= 10"""


def _beacon_columns(df):
    return df.select(
        "packet_id", "n_timestamps", "is_beacon", F.round(F.sqrt("gap_variance") / 1e9, 1).alias("jitter_seconds")
    )


@register("w8_beacon_jitter", fx.with_views("v_packets", body="") + _beacon_sql("src_ip, src_port, dst_ip, dst_port"))
def w8(spark, sf):
    return _beacon_columns(behaviour.beacons(fx.v_packets(spark, sf)))


@register("w8_beacon_by_source", fx.with_views("v_packets", body="") + _beacon_sql("src_ip"))
def w8_source(spark, sf):
    return _beacon_columns(behaviour.beacons(fx.v_packets(spark, sf), keys=("src_ip",)))


_SCAN_SQL = """
, f AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_port ORDER BY ts, packet_id) = 1 AS first_use FROM v_packets)
, c AS (SELECT packet_id, src_ip, CAST(sum(CAST(first_use AS INTEGER)) OVER (PARTITION BY src_ip ORDER BY ts, packet_id
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ports_seen FROM f)
SELECT packet_id, src_ip, ports_seen, ports_seen > 5 AS is_scan FROM c"""


@register("w9_port_scan", fx.with_views("v_packets", body="") + _SCAN_SQL)
def w9(spark, sf):
    return behaviour.port_scan(fx.v_packets(spark, sf)).select("packet_id", "src_ip", "ports_seen", "is_scan")


@register(
    "x1_packet_findings",
    fx.with_views("v_packets", body="") + _SCAN_SQL.replace("SELECT packet_id, src_ip, ports_seen, ports_seen > 5 AS is_scan FROM c", "") + """
SELECT packet_id, 'port_scan' AS inspector, 'IP probed ' || ports_seen || ' unique ports' AS details FROM c WHERE ports_seen > 5""",
)
def x1_packets(spark, sf):
    """Both packet inspectors; flows of the test packets are too short for a beacon."""
    return behaviour.packet_findings(fx.v_packets(spark, sf)).select("packet_id", "inspector", "details")


# ---------------------------------------------------------------------- health

RATED_SQL = """
, d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER s) / CAST(1000000 AS DOUBLE) AS dt,
    packets_captured - lag(packets_captured) OVER s AS dc, packets_processed - lag(packets_processed) OVER s AS dp,
    packets_dropped - lag(packets_dropped) OVER s AS dd FROM v_health WINDOW s AS (PARTITION BY sensor ORDER BY ts))
, rated AS (SELECT *, CASE WHEN dt > 0 THEN dc / dt ELSE 0.0 END AS capture_rate_pps,
    CASE WHEN dt > 0 THEN dp / dt ELSE 0.0 END AS processing_rate_pps,
    CASE WHEN dt > 0 AND dc > 0 THEN dd * CAST(100 AS DOUBLE) / dc ELSE 0.0 END AS drop_rate_percent FROM d)"""
LIMITS = {"drop": 20.0, "queue": 12, "cpu": 90.0, "memory": 1024.0, "disk": 90.0}
ALERTS_SQL = RATED_SQL + """
, alerts AS (
  SELECT sensor, ts, 'high_drop_rate' AS alert_type, CASE WHEN drop_rate_percent > 40 THEN 'critical' ELSE 'warning' END AS severity
    FROM rated WHERE drop_rate_percent > 20
  UNION ALL SELECT sensor, ts, 'queue_overflow', 'warning' FROM rated WHERE flows_in_queue > 12
  UNION ALL SELECT sensor, ts, 'interface_unavailable', 'critical' FROM rated WHERE NOT interface_available
  UNION ALL SELECT sensor, ts, 'high_cpu', 'warning' FROM rated WHERE cpu_usage_percent > 90
  UNION ALL SELECT sensor, ts, 'high_memory', 'warning' FROM rated WHERE memory_usage_mb > 1024
  UNION ALL SELECT sensor, ts, 'high_disk_usage', 'critical' FROM rated WHERE disk_usage_percent > 90)"""


def _rated(spark, sf):
    return health.health_rates(fx.v_health(spark, sf))


@register(
    "w10_health_rates",
    fx.with_views("v_health", body="") + RATED_SQL + " SELECT sensor, ts, capture_rate_pps, processing_rate_pps, drop_rate_percent FROM rated",
)
def w10(spark, sf):
    return _rated(spark, sf).select("sensor", "ts", "capture_rate_pps", "processing_rate_pps", "drop_rate_percent")


@register(
    "w11_threshold_alerts",
    fx.with_views("v_health", body="") + ALERTS_SQL + " SELECT sensor, ts, alert_type, severity FROM alerts",
)
def w11(spark, sf):
    return health.threshold_alerts(_rated(spark, sf), LIMITS).drop("message")


_KEPT_SQL = """
, RECURSIVE_PART
SELECT k.sensor, k.alert_type, k.ts, a.severity FROM kept k JOIN alerts a USING (sensor, alert_type, ts)"""


def _cooldown_sql(hours: int) -> str:
    step = f"""kept AS (SELECT sensor, alert_type, min(ts) AS ts FROM alerts GROUP BY ALL
  UNION ALL SELECT k.sensor, k.alert_type, min(a.ts) AS ts FROM kept k JOIN alerts a
    ON a.sensor = k.sensor AND a.alert_type = k.alert_type AND a.ts >= k.ts + INTERVAL {hours} HOUR
    GROUP BY k.sensor, k.alert_type)"""
    sql = fx.with_views("v_health", body="") + ALERTS_SQL + _KEPT_SQL.replace("RECURSIVE_PART", step)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("w12_alert_cooldown", _cooldown_sql(30))
def w12(spark, sf):
    alerts = health.threshold_alerts(_rated(spark, sf), LIMITS)
    return health.alert_cooldown(alerts, cooldown=30 * 3600.0).drop("message")


_CLEAR_SQL = """
, clears AS (SELECT sensor, ts, unnest(list_filter([CASE WHEN drop_rate_percent <= 10 THEN 'high_drop_rate' END,
    CASE WHEN flows_in_queue <= 12 * 0.8 THEN 'queue_overflow' END, CASE WHEN interface_available THEN 'interface_unavailable' END,
    CASE WHEN cpu_usage_percent <= 70 THEN 'high_cpu' END, CASE WHEN memory_usage_mb <= 512 THEN 'high_memory' END,
    CASE WHEN disk_usage_percent <= 80 THEN 'high_disk_usage' END], lambda x: x IS NOT NULL)) AS alert_type FROM rated)
SELECT a.sensor, a.alert_type, a.ts, a.severity, min(c.ts) AS resolved_at, min(c.ts) IS NOT NULL AS resolved
FROM alerts a LEFT JOIN clears c ON c.sensor = a.sensor AND c.alert_type = a.alert_type AND c.ts >= a.ts
GROUP BY a.sensor, a.alert_type, a.ts, a.severity"""


@register("w13_alert_resolution", fx.with_views("v_health", body="") + ALERTS_SQL + _CLEAR_SQL)
def w13(spark, sf):
    rated = _rated(spark, sf)
    return health.alert_resolution(health.threshold_alerts(rated, LIMITS), rated, LIMITS).drop("message")


@register(
    "w14_bounded_history",
    fx.with_views("v_health", body="SELECT sensor, ts, packets_captured FROM v_health QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY ts DESC) <= 60"),
)
def w14(spark, sf):
    return health.newest(fx.v_health(spark, sf), 60, keys=("sensor",)).select("sensor", "ts", "packets_captured")


@register(
    "g17_health_summary",
    fx.with_views("v_health", body="") + ALERTS_SQL + """
, r AS (SELECT * FROM rated ORDER BY ts DESC, sensor LIMIT 8)
SELECT CASE WHEN avg(drop_rate_percent) > 20 THEN 'critical' WHEN avg(drop_rate_percent) > 10 THEN 'warning' ELSE 'healthy' END AS status,
  round(avg(flows_in_queue), 1) AS avg_queue_size, arg_max(cpu_usage_percent, (ts, sensor)) AS cpu_usage_percent,
  arg_max(memory_usage_mb, (ts, sensor)) AS memory_usage_mb, (SELECT least(count(*), 100) FROM alerts) AS total_alerts FROM r""",
)
def g17(spark, sf):
    """The newest eight snapshots over all sensors, and the alerts on record."""
    rated = _rated(spark, sf)
    alerts = health.alert_resolution(health.threshold_alerts(rated, LIMITS), rated, LIMITS)
    out = health.health_summary(rated, LIMITS, last=8, alerts=alerts)
    return out.select("status", "avg_queue_size", "cpu_usage_percent", "memory_usage_mb", "total_alerts")


# ------------------------------------------------------------------- audit log


def audit_log(spark, sf, fields="props"):
    """Per-user audit lines whose chains hold, but for two kinds of damage.

    Line n names the digest of line n - 1, so building a chain is sequential.
    Logs are cut every 16 lines; the position that cuts them is skew-safe.
    """
    e = ordered(fx.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], [])
    number = F.col(POSITION) - 1
    lines = e.select(
        "user_id",
        F.floor(number / 16).alias("part"),
        (number % 16 + 1).cast("int").alias("line_no"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.col("event_type").alias("event"),
        (F.col(fields) if isinstance(fields, str) else fields).alias("fields"),
    )
    rows = F.array_sort(F.collect_list(F.struct("line_no", "ts", "event", "fields")))
    empty = F.array().cast("array<struct<line_no:int,ts:string,event:string,fields:string,prev_hash:string,hash:string>>")

    def link(done, row):
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["hash"], F.lit(audit.GENESIS))
        digest = audit.record_hash(row["ts"], row["event"], row["fields"], before)
        body = [row[c].alias(c) for c in ("line_no", "ts", "event", "fields")]
        return F.concat(done, F.array(F.struct(*body, before.alias("prev_hash"), digest.alias("hash"))))

    chained = lines.groupBy("user_id", "part").agg(F.aggregate(rows, empty, link).alias("c"))
    log_id = F.concat_ws("-", F.lit("log"), "user_id", "part")
    forged = (F.col("user_id") % 5 == 0) & (F.col("line_no") == 3)
    cut = (F.col("user_id") % 7 == 0) & (F.col("line_no") == 2)
    return chained.select("user_id", log_id.alias("log_id"), F.inline("c")).withColumns(
        {
            "event": F.when(forged, F.lit("forged")).otherwise(F.col("event")),
            "prev_hash": F.when(cut, F.lit("f" * 64)).otherwise(F.col("prev_hash")),
        }
    )


_CHAIN_SQL = """WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
, logs AS (SELECT user_id, 'log-' || user_id || '-' || (i // 16) AS log_id, count(*) AS n_lines FROM n GROUP BY ALL)
SELECT log_id, n_lines, NOT (user_id % 7 = 0 AND n_lines >= 2 OR user_id % 5 = 0 AND n_lines >= 3) AS ok,
  CASE WHEN user_id % 7 = 0 AND n_lines >= 2 THEN 'hash chain break at line 2'
       WHEN user_id % 5 = 0 AND n_lines >= 3 THEN 'hash mismatch at line 3' ELSE 'ok' END AS message
FROM (SELECT user_id, log_id, sum(n_lines) AS n_lines FROM logs GROUP BY ALL)"""


@register("w15_chain_verify", _CHAIN_SQL)
def w15(spark, sf):
    return audit.chain_verify(audit_log(spark, sf))


@register("w15_audit_lines", _CHAIN_SQL)
def w15_lines(spark, sf):
    """The same damage in JSON lines whose keys stand in another order, nested, spaced and beyond ASCII."""
    log = audit_log(spark, sf, F.concat(F.lit('{"n":{"a":'), "event_id", F.lit(',"b":[1,{"x":null,"\u00fc":2.5}]},"\u65e5\u672c":"\u00e9 \\"'), "user_id", F.lit('\\" \u20ac"}')))
    number = F.regexp_extract("fields", r'"a":(\d+)', 1)
    mixed = F.concat(F.lit('{ "\u65e5\u672c" : "\u00e9 \\"'), "user_id", F.lit('\\" \\u20ac", "n": {"b": [1, {"\u00fc": 2.50, "x": null}], "a": '), number, F.lit("}}"))
    text = {c: F.concat(F.lit(f'"{c}": "'), F.col(c), F.lit('"')) for c in ("ts", "event", "prev_hash", "hash")}
    line = F.concat(F.lit("{"), F.concat_ws(", ", text["hash"], text["ts"], F.concat(F.lit('"fields":'), mixed), text["event"], text["prev_hash"]), F.lit("}"))
    return audit.chain_verify(log.select("log_id", "line_no", line.alias("line")))


# --------------------------------------------------------------------- streams


def _packet_stream(spark, sf):
    return fx.packets_from(fx.stream_table(spark, sf, "events"))


@register("t1_stream_window_stats", fx.with_views("v_packets", body=_G1))
def t1(spark, sf):
    """All windows of the drained stream, the open ones completed at its stop."""
    return stream_windows.drain_window_stats(_packet_stream(spark, sf), 300)


@register("t2_stream_ip_history", fx.with_views("v_scores", body="") + HISTORY_SQL + f""" SELECT packet_id, src_ip, round(mean_score, 10) AS mean_score,
  mean_interval, ip_score_delta, interval_raw, {_DELTA}, ip_flow_count, is_burst, is_slow, is_periodic FROM history""")
def t2(spark, sf):
    out = run.drain(stateful.source_history(_packet_stream(spark, sf)), "t2")
    return out.withColumns({c: F.round(c, 10) for c in ("mean_score", "ip_score_delta")})


@register("t3_stream_beacon", fx.with_views("v_packets", body="") + _beacon_sql("src_ip"))
def t3(spark, sf):
    return _beacon_columns(run.drain(stateful.beacons(_packet_stream(spark, sf), keys=("src_ip",)), "t3"))


@register("t4_stream_port_scan", fx.with_views("v_packets", body="") + _SCAN_SQL)
def t4(spark, sf):
    return run.drain(stateful.port_scan(_packet_stream(spark, sf)), "t4")


def _dense(packets):
    """The same packets with time running 100,000 times faster, so buckets stay busy."""
    start = 1_704_067_200_000_000
    return packets.withColumn("ts", F.timestamp_micros(F.floor((F.unix_micros("ts") - start) / 100_000) + start))


_POLICE_SQL = """
, q AS (SELECT packet_id, dst_ip, packet_size, ((epoch_us(ts) - 1704067200000000) // 100000 + 1704067200000000) * 1000 AS ns FROM v_packets)
, n AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY ns, packet_id) AS i FROM q)
, fold AS (SELECT packet_id, dst_ip, i, ns, packet_size <= 2000 AS passed,
      CAST(CASE WHEN packet_size <= 2000 THEN 2000 - packet_size ELSE 2000 END AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS rest
    FROM n WHERE i = 1
  UNION ALL SELECT packet_id, dst_ip, i, ns, filled >= packet_size, CASE WHEN filled >= packet_size THEN filled - packet_size ELSE filled END, rest FROM (
    SELECT n.packet_id, n.dst_ip, n.i, n.ns, n.packet_size,
      CASE WHEN n.ns - f.ns >= 1000000000 THEN 2000 ELSE least(2000, f.tokens + ((n.ns - f.ns) * 1500 + f.rest) // 1000000000) END AS filled,
      CASE WHEN n.ns - f.ns >= 1000000000 OR f.tokens + ((n.ns - f.ns) * 1500 + f.rest) // 1000000000 > 2000 THEN 0
        ELSE ((n.ns - f.ns) * 1500 + f.rest) % 1000000000 END AS rest
    FROM fold f JOIN n ON n.dst_ip = f.dst_ip AND n.i = f.i + 1))
SELECT packet_id, dst_ip, passed FROM fold"""


@register("t5_rate_police", (fx.with_views("v_packets", body="") + _POLICE_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def t5(spark, sf):
    """Eight busy destinations, each a long uninterrupted sequence."""
    out = police.rate_police(_dense(fx.v_packets(spark, sf)), keys=("dst_ip",), rate=1500, capacity=2000)
    return out.select("packet_id", "dst_ip", "passed")


@register("t5_stream_rate_police", (fx.with_views("v_packets", body="") + _POLICE_SQL.replace("SELECT packet_id, dst_ip, passed", "SELECT packet_id, dst_ip AS src_ip, passed")).replace("WITH ", "WITH RECURSIVE ", 1))
def t5_stream(spark, sf):
    swapped = _dense(_packet_stream(spark, sf)).withColumn("src_ip", F.col("dst_ip"))
    return run.drain(stateful.rate_police(swapped, rate=1500, capacity=2000), "t5")


@register(
    "t6_first_block_only",
    fx.with_views("v_packets", body="") + DECISIONS_SQL + " SELECT DISTINCT src_ip, app_id, policy_tier, action FROM decisions WHERE policy_tier = 'Isolate'",
)
def t6(spark, sf):
    decisions = decide.policy_decisions(_packet_stream(spark, sf))
    return run.drain(stream_windows.first_block_only(decisions), "t6").select("src_ip", "app_id", "policy_tier", "action")


def _alert_stream(spark, sf):
    """(rows of the drained alert stream over the raw snapshots, its folder)."""
    folder = scratch_path(spark, "alerts")
    fx.v_health(spark, sf).write.parquet(f"{folder}/snapshots")
    snapshots = spark.readStream.schema(fx.v_health(spark, sf).schema).parquet(f"{folder}/snapshots")
    return run.drain(stateful.alert_stream(snapshots, LIMITS, 30 * 3600.0), "t7", folder=folder), folder


@register("t7_alert_stream", _cooldown_sql(30))
def t7(spark, sf):
    rows, _ = _alert_stream(spark, sf)
    return rows.where("kind = 'alert'").select("sensor", "alert_type", "ts", "severity")


@register(
    "t7_stream_rates",
    fx.with_views("v_health", body="") + RATED_SQL + " SELECT sensor, ts, capture_rate_pps, processing_rate_pps, drop_rate_percent FROM rated",
)
def t7_rates(spark, sf):
    rows, _ = _alert_stream(spark, sf)
    return rows.where("kind = 'rate'").select("sensor", "ts", "capture_rate_pps", "processing_rate_pps", "drop_rate_percent")


@register("t7_stream_resolution", fx.with_views("v_health", body="") + ALERTS_SQL + _CLEAR_SQL)
def t7_resolution(spark, sf):
    """Every alert: those cleared in the stream, and those open at its stop."""
    rows, folder = _alert_stream(spark, sf)
    done = rows.where("kind = 'resolved'").select("sensor", "alert_type", "ts", "severity", "resolved_at")
    every = done.unionByName(stateful.open_alerts(spark, folder, LIMITS).drop("message"), allowMissingColumns=True)
    return every.withColumn("resolved", F.col("resolved_at").isNotNull())


@register(
    "g13_dataset_profile",
    fx.with_views("v_flows", body='SELECT count(*) AS n_rows, 11 AS n_columns, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp, 1 AS files FROM v_flows'),
)
def g13(spark, sf):
    flows = fx.v_flows(spark, sf)
    return metrics.dataset_profile(flows, file=F.input_file_name())
