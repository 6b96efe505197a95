"""Audit log sink, prediction monitoring and sessions as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohort.operators.timelines import MONITOR_WINDOW, SESSION_GAP, monitor
from cohort.sources.logs import EVENT_TIME


def deduplicated(events: DataFrame, delay: str = "1 hour", key: str = "event_id",
                 ts: str = "timestamp") -> DataFrame:
    """Each event once, as long as its repeat comes within ``delay``."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def audit_sink(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour"):
    """Append-only JSON log of a stream of stamped events; returns the started query."""
    return (deduplicated(events, delay).writeStream.format("json").outputMode("append")
            .option("timestampFormat", EVENT_TIME)
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def monitored(predictions: DataFrame, window: str = MONITOR_WINDOW,
              delay: str = "1 minute") -> DataFrame:
    """Windowed monitoring of a stream (ts, class, confidence, latency_ms).

    Late rows beyond ``delay`` are dropped and counted in the query progress; windows that are
    still open at the end are not emitted.
    """
    return monitor(predictions.withWatermark("ts", delay), window)


def streamed_sessions(events: DataFrame, actor: str = "actor", gap: str = SESSION_GAP,
                      delay: str = "1 hour") -> DataFrame:
    """Sessions of each actor once they are closed."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap).alias("w"), actor)
            .agg(F.count("*").alias("events"), F.max("ts").alias("last_event"))
            .select(actor, F.col("w.start").alias("session_start"), "last_event", "events"))
