"""Telemetry views over the driver tables, and the same views as SQL for the oracle.

Columns are integer arithmetic and concatenation, so both engines agree exactly.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.session import configure, spread

AS_OF_TEXT = "2024-01-15 00:00:00"
SALT = "flowlake-demo-salt"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its zone-less timestamps read as UTC instants."""
    df = configure(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    df = configure(spark).readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def _address(prefix: str, number: Column) -> Column:
    parts = [F.floor(number / 65536) % 256, F.floor(number / 256) % 256, number % 256]
    return F.concat_ws(".", F.lit(prefix), *[p.cast("string") for p in parts])


def packets_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    port = (
        F.when(kind == "click", 443).when(kind == "view", 80).when(kind == "signup", 22)
        .when(kind == "purchase", 6881).otherwise(4444)
    )
    protocol = F.when(kind == "signup", "UDP").when(kind == "error", "ICMP").otherwise("TCP")
    return events.select(
        F.col("event_id").alias("packet_id"),
        "ts",
        _address("10", F.col("user_id")).alias("src_ip"),
        F.concat(F.lit("192.168.0."), (F.col("event_id") % 8).cast("string")).alias("dst_ip"),
        (40000 + F.col("user_id") % 20000).cast("int").alias("src_port"),
        (port + (F.col("event_id") % 2) * 1000).cast("int").alias("dst_port"),
        protocol.alias("protocol"),
        (64 + F.floor("value")).cast("long").alias("packet_size"),
        F.col("props").alias("payload"),
        (F.lit(0.1) - F.col("value") / 300).alias("if_score"),
        (F.col("event_id") % 3 == 0).alias("payload_available"),
    )


def v_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(table(spark, sf_dir, "events")).drop("if_score", "payload_available")


def v_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(table(spark, sf_dir, "events"))


def v_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"),
        _address("10", F.col("l_suppkey")).alias("src_ip"),
        _address("10", F.col("l_partkey")).alias("dst_ip"),
        (1024 + F.col("l_orderkey") % 60000).alias("src_port"),
        (F.col("l_partkey") % 1024).alias("dst_port"),
        F.when(flag == "A", "TCP").when(flag == "N", "UDP").otherwise("ICMP").alias("protocol"),
        F.floor("l_extendedprice").cast("long").alias("bytes_in"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("long").alias("bytes_out"),
        F.col("l_quantity").cast("long").alias("packets_in"),
        F.col("l_linenumber").cast("long").alias("packets_out"),
        (F.col("l_tax") * 100).alias("duration"),
    )


def v_dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = v_flows(spark, sf_dir)
    key = F.col("src_port") - 1024
    texts = {
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        "bytes_in": F.when(key % 17 == 0, "null").otherwise(F.col("bytes_in").cast("string")),
        "dst_ip": F.when(key % 19 == 0, "").otherwise(F.col("dst_ip")),
        "duration": F.when(key % 23 == 0, "n/a").otherwise(F.floor("duration").cast("string")),
    }
    return flows.select(*[texts.get(c, F.col(c).cast("string")).alias(c) for c in flows.columns])


def v_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_packets(spark, sf_dir).select(
        F.col("ts").alias("window_start"),
        F.col("src_ip").alias("src_ip_anon"),
        F.col("dst_ip").alias("dst_ip_anon"),
        "protocol",
        "src_port",
        "dst_port",
        F.lit(5.0).alias("duration_seconds"),
        (F.col("packet_id") % 50).alias("packet_count"),
        F.col("packet_size").alias("byte_count"),
        (F.col("packet_id") % 7).alias("dst_flow_packets"),
        F.when(F.col("packet_id") % 11 != 0, F.col("packet_size") % 100).alias("dst_flow_bytes"),
        "packet_id",
    )


def v_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.col("text").alias("payload")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("payload")
    )
    return spread(documents.unionByName(pages))


def _hours_later(start: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + hours * 3_600_000_000)


def v_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    created = _hours_later(start, key % 720)
    risk = F.when(balance < 0, "critical").when(balance < 2500, "high").when(balance < 5000, "medium").otherwise("low")
    return table(spark, sf_dir, "customer").select(
        _address("10", key).alias("ip_address"),
        F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("reason"),
        F.when(key % 2 == 0, "prediction").otherwise("manual").alias("source"),
        risk.alias("risk_level"),
        created.alias("created_at"),
        F.when(key % 3 != 0, _hours_later(created, 24 * (key % 10))).alias("expires_at"),
        (key % 5 != 0).alias("is_active"),
        F.lit("none").alias("enforcement_action"),
        F.lit(0).cast("long").alias("hit_count"),
        created.alias("last_seen"),
        F.lit(None).cast("string").alias("metadata"),
    )


def v_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 5 == 0).select(
        _address("10", F.col("s_suppkey")).alias("ip"),
        F.lit("supplier").alias("reason"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"),
        F.lit("active").alias("status"),
    )


def health_from(events: DataFrame) -> DataFrame:
    """One snapshot per sensor (destination) and six hours, cumulative counters."""
    from pyspark.sql import Window

    bucket = F.floor(F.unix_micros("ts") / 21_600_000_000).cast("long")
    counts = events.groupBy((F.col("event_id") % 8).alias("s"), bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e")
    )
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        F.concat(F.lit("sensor-"), F.col("s").cast("string")).alias("sensor"),
        F.timestamp_micros(F.col("b") * 21_600_000_000).alias("ts"),
        F.sum("n").over(upto).alias("packets_captured"),
        F.sum(F.col("n") - F.col("e")).over(upto).alias("packets_processed"),
        F.sum("e").over(upto).alias("packets_dropped"),
        F.col("n").alias("flows_in_queue"),
        (F.col("n") % 7 != 0).alias("interface_available"),
        (F.col("n") * 13 % 100).cast("double").alias("cpu_usage_percent"),
        (F.col("n") * 101 % 1500).cast("double").alias("memory_usage_mb"),
        (F.col("e") * 29 % 100).cast("double").alias("disk_usage_percent"),
    )


def v_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_from(table(spark, sf_dir, "events"))


def v_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        F.col("toxic").alias("y"),
        (1 - F.col("quality")).alias("pred"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("text").alias("payload"),
    )


# ---------------------------------------------------------------- oracle side


def _sql_address(prefix: str, n: str) -> str:
    return f"'{prefix}.' || (({n}) // 65536 % 256) || '.' || (({n}) // 256 % 256) || '.' || (({n}) % 256)"


_PACKET_COLUMNS = f"""
  event_id AS packet_id, ts, {_sql_address('10', 'user_id')} AS src_ip,
  '192.168.0.' || (event_id % 8) AS dst_ip, 40000 + user_id % 20000 AS src_port,
  CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'signup' THEN 22
       WHEN 'purchase' THEN 6881 ELSE 4444 END + (event_id % 2) * 1000 AS dst_port,
  CASE event_type WHEN 'signup' THEN 'UDP' WHEN 'error' THEN 'ICMP' ELSE 'TCP' END AS protocol,
  64 + CAST(floor(value) AS BIGINT) AS packet_size, props AS payload,
  CAST(0.1 AS DOUBLE) - value / 300 AS if_score, event_id % 3 = 0 AS payload_available"""

VIEWS: dict[str, str] = {
    "v_scores": f"SELECT {_PACKET_COLUMNS} FROM events",
    "v_packets": f"SELECT * EXCLUDE (if_score, payload_available) FROM (SELECT {_PACKET_COLUMNS} FROM events)",
    "v_flows": f"""SELECT l_shipdate AS "timestamp", {_sql_address('10', 'l_suppkey')} AS src_ip,
  {_sql_address('10', 'l_partkey')} AS dst_ip, 1024 + l_orderkey % 60000 AS src_port,
  l_partkey % 1024 AS dst_port,
  CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'N' THEN 'UDP' ELSE 'ICMP' END AS protocol,
  CAST(floor(l_extendedprice) AS BIGINT) AS bytes_in,
  CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS bytes_out,
  CAST(l_quantity AS BIGINT) AS packets_in, CAST(l_linenumber AS BIGINT) AS packets_out,
  l_tax * 100 AS duration FROM lineitem""",
    "v_blocklist": f"""SELECT {_sql_address('10', 'c_custkey')} AS ip_address,
  'segment ' || c_mktsegment AS reason,
  CASE WHEN c_custkey % 2 = 0 THEN 'prediction' ELSE 'manual' END AS source,
  CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal < 2500 THEN 'high'
       WHEN c_acctbal < 5000 THEN 'medium' ELSE 'low' END AS risk_level,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey % 720 AS INTEGER)) AS created_at,
  CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00'
       + to_hours(CAST(c_custkey % 720 + 24 * (c_custkey % 10) AS INTEGER)) END AS expires_at,
  c_custkey % 5 <> 0 AS is_active, 'none' AS enforcement_action, CAST(0 AS BIGINT) AS hit_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey % 720 AS INTEGER)) AS last_seen,
  CAST(NULL AS VARCHAR) AS metadata FROM customer""",
    "v_trusted": f"SELECT {_sql_address('10', 's_suppkey')} AS ip FROM supplier WHERE s_suppkey % 5 = 0",
    "v_payloads": """SELECT doc_id AS id, 'document' AS kind, text AS payload FROM documents
  UNION ALL SELECT page_id, 'page', html FROM pages""",
    "v_labelled": """SELECT doc_id, toxic AS y, 1 - quality AS pred, CAST(n_chars AS DOUBLE) AS score, text AS payload
  FROM labels JOIN documents USING (doc_id)""",
    "v_health": """SELECT 'sensor-' || s AS sensor, make_timestamp(b * 21600000000) AS ts,
  CAST(sum(n) OVER w AS BIGINT) AS packets_captured, CAST(sum(n - e) OVER w AS BIGINT) AS packets_processed,
  CAST(sum(e) OVER w AS BIGINT) AS packets_dropped, n AS flows_in_queue, n % 7 <> 0 AS interface_available,
  CAST(n * 13 % 100 AS DOUBLE) AS cpu_usage_percent, CAST(n * 101 % 1500 AS DOUBLE) AS memory_usage_mb,
  CAST(e * 29 % 100 AS DOUBLE) AS disk_usage_percent
  FROM (SELECT event_id % 8 AS s, epoch_us(ts) // 21600000000 AS b, count(*) AS n,
               count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY ALL)
  WINDOW w AS (PARTITION BY s ORDER BY b ROWS UNBOUNDED PRECEDING)""",
}
VIEWS["v_window_rows"] = f"""SELECT ts AS window_start, src_ip AS src_ip_anon, dst_ip AS dst_ip_anon, protocol,
  src_port, dst_port, CAST(5.0 AS DOUBLE) AS duration_seconds, packet_id % 50 AS packet_count,
  packet_size AS byte_count, packet_id % 7 AS dst_flow_packets,
  CASE WHEN packet_id % 11 <> 0 THEN packet_size % 100 END AS dst_flow_bytes, packet_id
  FROM ({VIEWS['v_packets']})"""
VIEWS["v_dirty_flows"] = f"""SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", src_ip,
  CASE WHEN (src_port - 1024) % 19 = 0 THEN '' ELSE dst_ip END AS dst_ip,
  CAST(src_port AS VARCHAR) AS src_port, CAST(dst_port AS VARCHAR) AS dst_port, protocol,
  CASE WHEN (src_port - 1024) % 17 = 0 THEN 'null' ELSE CAST(bytes_in AS VARCHAR) END AS bytes_in,
  CAST(bytes_out AS VARCHAR) AS bytes_out, CAST(packets_in AS VARCHAR) AS packets_in,
  CAST(packets_out AS VARCHAR) AS packets_out,
  CASE WHEN (src_port - 1024) % 23 = 0 THEN 'n/a' ELSE CAST(CAST(floor(duration) AS BIGINT) AS VARCHAR) END AS duration
  FROM ({VIEWS['v_flows']})"""


def with_views(*names: str, body: str) -> str:
    """``body`` preceded by the named views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + body
