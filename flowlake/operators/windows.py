"""Tumbling-window traffic statistics over packet tables (batch and streaming)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions import ip
from flowlake.functions.encode import rounded

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def _flow_groups(packets: DataFrame, seconds: int) -> DataFrame:
    """One row per window and 5-tuple.

    Everything below builds on this single partial-aggregated shuffle. Grouping
    is by packed address, so two spellings of one IPv6 address meet, and the
    keyed hash runs once per flow rather than once per packet.
    """
    bucket = F.window("ts", f"{seconds} seconds")
    return (
        packets.select(
            bucket.alias("w"),
            ip.packed_ip(F.col("src_ip")).alias("src"),
            ip.packed_ip(F.col("dst_ip")).alias("dst"),
            "src_port",
            "dst_port",
            "protocol",
            "packet_size",
            "ts",
        )
        .groupBy("w", "src", "dst", "src_port", "dst_port", "protocol")
        .agg(
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("packet_size").alias("byte_count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )


def roll_up(flows: DataFrame, seconds: int) -> DataFrame:
    """Window totals of flow entries (w, src, dst, packet_count, byte_count)."""
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    totals = flows.groupBy("w").agg(
        F.sum("packet_count").alias("packet_count"),
        F.sum("byte_count").alias("byte_count"),
        F.count_if(known).alias("unique_flows"),
    )
    return with_rates(totals, seconds)


def with_rates(totals: DataFrame, seconds: int) -> DataFrame:
    return totals.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        F.lit(float(seconds)).alias("duration_seconds"),
        "packet_count",
        "byte_count",
        "unique_flows",
        rounded(F.col("packet_count") / F.lit(float(seconds)), 2).alias("rate_pps"),
        rounded(F.col("byte_count") * 8 / F.lit(float(seconds)), 2).alias("rate_bps"),
    )


def window_stats(packets: DataFrame, seconds: int = 5) -> DataFrame:
    """Packets, bytes, distinct flows and rates per window; empty windows are not emitted.

    Packets without a valid address pair count as traffic but form no flow.
    """
    return roll_up(_flow_groups(packets, seconds), seconds)


def flow_stats(packets: DataFrame, salt: str | bytes, seconds: int = 5) -> DataFrame:
    """Per-window 5-tuple statistics with hashed addresses."""
    flows = _flow_groups(packets, seconds).filter("src IS NOT NULL AND dst IS NOT NULL")
    span = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / F.lit(1e6)
    return flows.select(
        F.col("w.start").alias("window_start"),
        ip.hash_packed(F.col("src"), salt).alias("src_ip_anon"),
        ip.hash_packed(F.col("dst"), salt).alias("dst_ip_anon"),
        "src_port",
        "dst_port",
        "protocol",
        "packet_count",
        "byte_count",
        "first_seen",
        "last_seen",
        span.alias("duration_seconds"),
        (F.col("byte_count") / F.col("packet_count")).alias("avg_packet_size"),
    )


def protocol_counts(packets: DataFrame, seconds: int = 5) -> DataFrame:
    """Map of protocol to packet count per window."""
    per_protocol = (
        packets.withColumn("protocol", F.coalesce("protocol", F.lit("unknown")))
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "protocol")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col("protocol").alias("key"), F.col("n").alias("value"))))
    return per_protocol.groupBy("w").agg(F.map_from_entries(entries).alias("protocol_counts")).select(
        F.col("w.start").alias("window_start"), "protocol_counts"
    )


def flow_rows(packets: DataFrame, salt: str | bytes, seconds: int = 5) -> DataFrame:
    """The 18-column window rows: one per flow, with its reverse flow as the "dst" side.

    A row is stamped with the end of its window. Both directions of a
    conversation meet by grouping on an order-free key, so no self-join is
    needed. Conversations and window totals read the same per-flow counts and
    columns, so Spark runs that shuffle once and reuses it. The totals are
    joined back on the window, a table that grows with time, not with traffic.
    """
    flows = _flow_groups(packets, seconds)
    totals = roll_up(flows, seconds)
    here = F.struct(F.col("src").alias("ip"), F.col("src_port").alias("port"))
    there = F.struct(F.col("dst").alias("ip"), F.col("dst_port").alias("port"))
    # Flows without addresses are dropped after grouping: a filter here would be
    # pushed below the shared shuffle and make it two.
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    pairs = (
        flows.withColumns({"low": F.least(here, there), "high": F.greatest(here, there), "forward": here <= there})
        .groupBy("w", "low", "high", "protocol")
        .agg(
            *[
                F.sum(F.when(known & (F.col("forward") == way), F.col(count))).alias(f"{name}_{count}")
                for way, name in ((True, "out"), (False, "back"))
                for count in ("packet_count", "byte_count")
            ]
        )
    )

    def direction(source: str, target: str, own: str, reverse: str) -> Column:
        fields = [F.col(source).alias("src"), F.col(target).alias("dst")]
        for side, name in ((own, "own"), (reverse, "reverse")):
            fields += [F.col(f"{side}_packet_count").alias(f"{name}_packets"), F.col(f"{side}_byte_count").alias(f"{name}_bytes")]
        return F.when(F.col(f"{own}_packet_count").isNotNull(), F.struct(*fields))

    both = F.array_compact(F.array(direction("low", "high", "out", "back"), direction("high", "low", "back", "out")))
    zero = F.lit(0)
    return (
        pairs.select("w", "protocol", F.explode(both).alias("f"))
        .withColumn("window_start", F.col("w.start"))
        .join(totals, "window_start")
        .select(
            F.col("window_end").alias("timestamp"),
            "window_start",
            "window_end",
            "duration_seconds",
            "packet_count",
            "byte_count",
            "unique_flows",
            "rate_pps",
            "rate_bps",
            ip.hash_packed(F.col("f.src.ip"), salt).alias("src_ip_anon"),
            ip.hash_packed(F.col("f.dst.ip"), salt).alias("dst_ip_anon"),
            "protocol",
            F.col("f.src.port").alias("src_port"),
            F.col("f.dst.port").alias("dst_port"),
            F.col("f.own_packets").alias("src_flow_packets"),
            F.col("f.own_bytes").alias("src_flow_bytes"),
            F.coalesce("f.reverse_packets", zero).alias("dst_flow_packets"),
            F.coalesce("f.reverse_bytes", zero).alias("dst_flow_bytes"),
        )
    )


def traffic_counters(packets: DataFrame, seconds: int = 5) -> DataFrame:
    """Totals over the whole table: packets, bytes, windows and flow entries."""
    flows = _flow_groups(packets, seconds)
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    per_window = flows.groupBy("w").agg(
        F.sum("packet_count").alias("packets"),
        F.sum("byte_count").alias("bytes"),
        F.count_if(known).alias("flows"),
    )
    return per_window.agg(
        F.sum("packets").alias("packets_processed"),
        F.sum("bytes").alias("bytes_processed"),
        F.count(F.lit(1)).alias("windows_completed"),
        F.sum("flows").alias("flows_tracked"),
    )


def counter_totals(counters: DataFrame) -> DataFrame:
    """Sum of per-worker partial counters into one row."""
    return counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("passed", "dropped", "bytes")])
