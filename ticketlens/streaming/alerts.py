"""Alert feed: new critical recommendations as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ALERT_SEVERITY = "CRITIQUE"


def alert_payload(recos: DataFrame) -> DataFrame:
    return recos.select(
        F.lit("alert").alias("type"),
        "severity", "title", "description",
        F.col("id").alias("recommendation_id"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def alert_stream(
    recos: DataFrame, start: Column | None = None, delay: str = "14 days", now: Column | None = None
) -> DataFrame:
    """Critical rows created after ``start``, each id once within ``delay`` of event time.

    ``recos`` is a streaming frame; the checkpoint takes the place of a high-water mark, so a
    restart neither replays nor loses alerts. The default delay is the life of a
    recommendation: it bounds the state, and what comes later than that has expired anyway
    (the query's progress counts it as ``numRowsDroppedByWatermark``). Rows dated ahead count
    as created ``now`` (by default each micro-batch's time), so that they do not push the
    watermark past those that follow.
    """
    critical = recos.filter(F.col("severity") == ALERT_SEVERITY)
    if start is not None:
        critical = critical.filter(F.col("created_at") > start)
    timed = critical.withColumn(
        "_at", F.least(F.col("created_at").cast("timestamp"), F.current_timestamp() if now is None else now.cast("timestamp"))
    )
    once = timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["id"])
    return alert_payload(once)


def run_alerts(alerts: DataFrame, sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the payloads to a Parquet folder; exactly once through its commit log."""
    return (
        alerts.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
