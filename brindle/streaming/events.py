"""Windows over event tables and streams, and matching of uploads as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and value sums by event type and window; `late`: watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def match_stream(spark: SparkSession, path: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """A query that hands each batch of newly uploaded item files (JSON lines) to `handle`; progress is
    the query's lastProgress."""
    items = spark.readStream.schema(schema).json(path)
    return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()


def progress(query) -> dict:
    """status, batches and rows of a running or finished query."""
    done = [p for p in query.recentProgress]
    failed = query.exception()
    return {"status": "error" if failed else "running" if query.isActive else "done", "batches": len(done), "rows": sum(p["numInputRows"] for p in done), "error": str(failed) if failed else None}
