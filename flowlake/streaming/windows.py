"""Event-time window statistics and de-duplication over packet streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.operators import windows
from flowlake.session import scratch_path
from flowlake.streaming import run

LATENESS = "10 minutes"


def window_stats(packets: DataFrame, seconds: int = 5, lateness: str = LATENESS) -> DataFrame:
    """Window statistics, each window emitted once the watermark passes its end.

    The same two aggregations as the batch operator: flow entries per window,
    then window totals. Packets later than ``lateness`` are dropped and counted
    in the query progress.
    """
    return windows.window_stats(packets.withWatermark("ts", lateness), seconds)


def drain_window_stats(packets: DataFrame, seconds: int = 5, lateness: str = LATENESS, folder: str | None = None) -> DataFrame:
    """Window statistics of everything that is available now, windows still open at the stop included.

    Closed windows are appended by the stream, once each. Open ones are completed from the flow entries
    that the stream keeps as state, without ending them: a later call with the same ``folder`` goes on
    with that state, and a window that closed in the meantime comes from the stream alone.
    """
    spark = packets.sparkSession
    folder = folder or scratch_path(spark, "windows")
    closed = run.drain(window_stats(packets, seconds, lateness), "windows", folder=folder)
    if not run.has_state(spark, folder):
        return closed
    totals, flows = (run.state_of(spark, folder, operator) for operator in (0, 1))
    entries = flows.select("key.*", F.col("value.count").alias("packet_count"), F.col("value.sum").alias("byte_count"))
    # a window whose flows were handed over, but whose total was not yet written when the stream stopped
    pending = totals.select("key.w", "value.*").toDF("w", "packet_count", "byte_count", "unique_flows")
    return closed.unionByName(windows.roll_up(entries, seconds)).unionByName(windows.with_rates(pending, seconds))


def protocol_counts(packets: DataFrame, seconds: int = 5, lateness: str = LATENESS) -> DataFrame:
    return windows.protocol_counts(packets.withWatermark("ts", lateness), seconds)


def first_block_only(decisions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One block action per source for as long as the watermark remembers it."""
    blocked = decisions.filter(F.col("policy_tier") == "Isolate").withWatermark("ts", lateness)
    return blocked.dropDuplicatesWithinWatermark(["src_ip"])
