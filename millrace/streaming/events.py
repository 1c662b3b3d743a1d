"""Structured Streaming over the execution events: state per agent and per stage, replayable in batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, d: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a file stream, with a time stamp that watermarks accept."""
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its result table."""
    name = f"drained_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def counts_by_type(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("total"))


def window_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by day and type; state older than the watermark goes."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def ema_state(stream: DataFrame, weight: float = 0.3) -> DataFrame:
    """Moving average of success by event type as keyed state: one number and a count for each key."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for x in (rows["value"] > 50.0).astype(float):
            ema, n = (x if n == 0 else weight * x + (1 - weight) * ema), n + 1
        state.update((float(ema), int(n)))
        yield pd.DataFrame({"event_type": [key[0]], "ema": [round(float(ema), 6)], "n": [n]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy("event_type").applyInPandasWithState(update, "event_type string, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)
