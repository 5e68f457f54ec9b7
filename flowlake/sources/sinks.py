"""Sinks: window CSV files, blocklist documents, security-event messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from flowlake.functions.encode import rounded
from flowlake.operators.clean import require_columns
from flowlake.schemas import WINDOW_COLUMNS

ROWS_PER_FILE = 10_000


def window_csv_rows(rows: DataFrame) -> DataFrame:
    """The 18 CSV columns in order, times as ISO-8601 UTC and rates at two decimals."""
    require_columns(rows, WINDOW_COLUMNS)

    def shape(name: str):
        if name in ("timestamp", "window_start", "window_end"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(name)
        if name in ("rate_pps", "rate_bps"):
            return rounded(F.col(name), 2).alias(name)
        return F.col(name)

    return rows.select(*[shape(c) for c in WINDOW_COLUMNS])


def sink_window_csv(rows: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "append") -> None:
    """Write window rows; every task starts a new file after ``rows_per_file`` rows."""
    writer = window_csv_rows(rows).write.mode(mode).option("header", True)
    writer.option("maxRecordsPerFile", rows_per_file).csv(path)


def stream_window_csv(rows: DataFrame, path: str, checkpoint: str, rows_per_file: int = ROWS_PER_FILE) -> DataStreamWriter:
    """Streaming form of the CSV sink.

    A folder per micro-batch, overwritten on replay, makes a retried batch harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sink_window_csv(batch, f"{path}/batch={batch_id}", rows_per_file, "overwrite")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def publish_events(messages: DataFrame, path: str, checkpoint: str, fmt: str = "json", **options) -> DataStreamWriter:
    """Stream key/value messages to files or, with fmt="kafka", to a topic."""
    writer = messages.writeStream.format(fmt).option("checkpointLocation", checkpoint).options(**options)
    return writer if fmt == "kafka" else writer.option("path", path)
