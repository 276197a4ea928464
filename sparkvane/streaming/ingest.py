"""Streaming ingest into a partitioned database folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timebucket import bucket_name


def write_stream(vectors: DataFrame, database, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of vectors to a PartitionedDB; a batch that is replayed replaces what it wrote before.

    No watermark: a late row goes to the newest bucket of its own time.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        database.add_batch(batch, f"stream-{batch_id:012d}")

    return vectors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "1 day", *keys: str) -> DataFrame:
    """Counts by tumbling event-time windows; a stream drops rows later than `late`."""
    rows = events.withColumn("event_time", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("event_time", late)
    return rows.groupBy(F.window("event_time", size), *keys).agg(F.count("*").alias("n"))


def bucketed_counts(events: DataFrame, granularity: str = "hourly", *keys: str) -> DataFrame:
    """Counts by calendar buckets of ts_ms."""
    return events.groupBy(bucket_name(F.col("ts_ms"), granularity).alias("ts_partition"), *keys).agg(F.count("*").alias("n"))
