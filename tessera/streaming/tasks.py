"""The task log as streams: current states kept by an upsert, and leases that run out.

Events are (task_id, ts, event_type). Both forms give what the batch operators in
`tessera.operators.tasks` give over the same events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_states(events: DataFrame) -> DataFrame:
    """A running table of each task's last event; write it with outputMode update (or complete)."""
    return events.groupBy("task_id").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("event_type"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("events"))


def lost_leases(heartbeats: DataFrame, lease: str, late: str) -> DataFrame:
    """(task_id, first, last, beats) of each run of heartbeats that ended: no beat came for ``lease``; beats up to ``late`` late still count.

    Session windows close by the watermark, so state is bounded by the tasks that run; append mode.
    """
    runs = heartbeats.withWatermark("ts", late).groupBy("task_id", F.session_window("ts", lease)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("beats"))
    return runs.select("task_id", "first", "last", "beats")


def event_counts(events: DataFrame, window: str, late: str) -> DataFrame:
    """Events of each type in tumbling windows."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("begin"), "event_type", "n")
