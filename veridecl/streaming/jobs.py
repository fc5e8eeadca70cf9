"""Structured Streaming forms of the audit log, the login throttle, upload duplicates, the pipeline and the rollup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import audit_events

LATE = "1 day"


def stream_audit(requests: DataFrame) -> DataFrame:
    """Requests as audit events, for append output."""
    return audit_events(requests)


def stream_login_throttle(requests: DataFrame, window: str = "15 minutes", limit: int = 5, late: str = LATE) -> DataFrame:
    """Clients with more than ``limit`` logins in a window; attempts later than ``late`` are not counted."""
    logins = requests.filter(F.col("path") == "/api/v1/auth/login").withWatermark("ts", late)
    counts = logins.groupBy(F.window("ts", window), "actor_id").agg(F.count("*").alias("attempts"))
    return counts.filter(F.col("attempts") > limit).select(F.col("window.start").alias("window_start"), "actor_id", "attempts")


def stream_dedup(uploads: DataFrame, late: str = "7 days") -> DataFrame:
    """The first upload of each content within the watermark; one that returns later is taken for new."""
    return uploads.withWatermark("uploaded_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def stream_rollup(inspections: DataFrame, late: str = LATE) -> DataFrame:
    """Inspections by day and status, kept up to date."""
    return inspections.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "overall_status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "overall_status", "n")


def stream_pipeline(tokens: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Each batch of tokens through ``decide``, into a folder of its own that a repeated batch overwrites; of empty batches
    only the first, so that there is a table with columns."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()  # else what is behind it, such as keyed state, runs for each use
        try:
            if not number or not batch.isEmpty():
                decide(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return tokens.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is, and waits."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
