"""Structured Streaming over event tables: windows with watermarks, sessions, and an audit sink. An extension: the batch
forms of the same functions serve for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """event_type, start, n, total for each window; with a watermark where events is a stream."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    got = rows.groupBy("event_type", F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
    )
    return got.select("event_type", F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """user_id, start, end, n for each run of events of a user with pauses below the gap."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    got = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return got.select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n",
    )


def audit_sink(stream: DataFrame, log, action: str, checkpoint: str):
    """A running query that appends one audit entry for each micro-batch: the chain has one writer, the driver."""

    def write(batch: DataFrame, number: int) -> None:
        log.record(action, actor="stream", batch=number, rows=batch.count())

    return stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint,
    ).trigger(availableNow=True).start()
