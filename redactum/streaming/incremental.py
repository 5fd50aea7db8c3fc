"""Incremental processing: windows over event streams, idempotent appends, retries, periodic compaction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """A folder's event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) per window; rows later than the watermark are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap of that size."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark: the stream's idempotent append."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def retry_counts(events: DataFrame, limit: int = 1) -> DataFrame:
    """(user_id, failures, requeue): failures per key in state; a key is queued again at most `limit` times."""
    def count(key, batches, state: GroupState):
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            n += int((pdf["event_type"] == "error").sum())
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [n], "requeue": [0 < n <= limit]})

    return events.groupBy("user_id").applyInPandasWithState(count, "user_id long, failures long, requeue boolean", "n long", "update", GroupStateTimeout.NoTimeout)


def compacted(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Run `each(batch, epoch)` over micro-batches until the input is used up; epochs make it idempotent."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write everything that is there to Parquet and read it back."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
