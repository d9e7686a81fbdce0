"""Structured Streaming forms of the incremental jobs.

Each takes a streaming frame and returns one; sinks and triggers are the
caller's.  State is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bursts(events: DataFrame, entity: str, at: str, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each entity, out when no event can extend them any more."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), entity).agg(F.count(F.lit(1)).alias("n")).select(entity, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_within(events: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """The first copy of each key that arrives; copies later than ``late`` aren't remembered."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by kind and window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def backfill(rows: DataFrame, embed: Callable, write: Callable[[DataFrame, int], None]):
    """A writer that gives rows without an embedding one, batch by batch; blank bodies are left out.

    ``embed`` maps a Column of texts to a Column of vectors, ``write`` stores
    a batch and must be idempotent by batch id.
    """

    def batch(df: DataFrame, no: int) -> None:
        todo = df.filter("embedding is null and trim(body) <> ''")
        write(todo.withColumn("embedding", embed(F.col("body"))), no)

    return rows.writeStream.foreachBatch(batch)
