"""Column lists and Spark schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("interface", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("packet_size", T.LongType()),
        T.StructField("raw_data", T.BinaryType()),
    ]
)

# Column names of flow files, window files, frames, blocklist and router input.
FLOW_COLUMNS = [
    "timestamp",
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "protocol",
    "bytes_in",
    "bytes_out",
    "packets_in",
    "packets_out",
    "duration",
]

WINDOW_COLUMNS = [
    "timestamp",
    "window_start",
    "window_end",
    "duration_seconds",
    "packet_count",
    "byte_count",
    "unique_flows",
    "rate_pps",
    "rate_bps",
    "src_ip_anon",
    "dst_ip_anon",
    "protocol",
    "src_port",
    "dst_port",
    "src_flow_packets",
    "src_flow_bytes",
    "dst_flow_packets",
    "dst_flow_bytes",
]

# Typed view of both flow schemas; every other column of a file stays a string.
LONG_COLUMNS = [
    "src_port",
    "dst_port",
    "bytes_in",
    "bytes_out",
    "packets_in",
    "packets_out",
    "packet_count",
    "byte_count",
    "src_flow_packets",
    "src_flow_bytes",
    "dst_flow_packets",
    "dst_flow_bytes",
]
DOUBLE_COLUMNS = ["duration", "duration_seconds", "rate_pps", "rate_bps"]

# Columns that are forced to a number, non-numbers becoming zero.
NUMERIC_COLUMNS = [
    "src_port",
    "dst_port",
    "bytes_in",
    "bytes_out",
    "packets_in",
    "packets_out",
    "duration",
    "packet_count",
    "byte_count",
    "rate_pps",
    "rate_bps",
    "src_flow_packets",
    "src_flow_bytes",
    "dst_flow_packets",
    "dst_flow_bytes",
]

MODEL_FEATURES = [
    "bytes_in",
    "bytes_out",
    "packets_in",
    "packets_out",
    "duration",
    "src_port",
    "dst_port",
    "protocol",
]
LOG_FEATURES = ["bytes_in", "bytes_out", "packets_in", "packets_out", "duration"]

FRAME = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("bytes_in", T.LongType()),
        T.StructField("bytes_out", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("payload", T.StringType()),
    ]
)
LABELLED_FRAME = T.StructType(FRAME.fields + [T.StructField("label", T.StringType())])

BLOCKLIST_COLUMNS = [
    "ip_address",
    "reason",
    "source",
    "risk_level",
    "created_at",
    "expires_at",
    "is_active",
    "enforcement_action",
    "hit_count",
    "last_seen",
    "metadata",
]

ROUTER_FEATURES = [
    "if_score",
    "ip_score_delta",
    "ip_seen_before",
    "ip_flow_count",
    "hour_of_day",
    "day_of_week",
    "is_night",
    "is_business_hours",
    "in_boot_window",
    "interval_raw",
    "interval_delta",
    "is_burst",
    "is_slow",
    "is_periodic",
    "protocol",
    "dst_port",
    "payload_available",
]

# Intrusion benchmark file: 41 features, a label and a difficulty, in file order.
# Columns of the public intrusion file, in its order.
INTRUSION_COLUMNS = [
    "duration",
    "protocol_type",
    "service",
    "flag",
    "src_bytes",
    "dst_bytes",
    "land",
    "wrong_fragment",
    "urgent",
    "hot",
    "num_failed_logins",
    "logged_in",
    "num_compromised",
    "root_shell",
    "su_attempted",
    "num_root",
    "num_file_creations",
    "num_shells",
    "num_access_files",
    "num_outbound_cmds",
    "is_host_login",
    "is_guest_login",
    "count",
    "srv_count",
    "serror_rate",
    "srv_serror_rate",
    "rerror_rate",
    "srv_rerror_rate",
    "same_srv_rate",
    "diff_srv_rate",
    "srv_diff_host_rate",
    "dst_host_count",
    "dst_host_srv_count",
    "dst_host_same_srv_rate",
    "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate",
    "dst_host_srv_serror_rate",
    "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate",
    "label",
    "difficulty",
]
INTRUSION_TEXT = {"protocol_type", "service", "flag", "label"}
INTRUSION = T.StructType(
    [
        T.StructField(c, T.StringType() if c in INTRUSION_TEXT else T.DoubleType())
        for c in INTRUSION_COLUMNS
    ]
)
