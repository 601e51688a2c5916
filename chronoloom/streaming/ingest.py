"""Incremental processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def arriving(spark: SparkSession, folder: str, schema: T.StructType = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    """SS-01: files of a folder as they arrive. The event time becomes a timestamp, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def on_arrival(stream: DataFrame, checkpoint: str, job: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """SS-01, SS-02, SS-04: runs a derived job for each batch; the checkpoint holds what has been done, so a restart
    goes on from there. ``every`` is the scan's interval; without it what is there is processed once."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(job)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def idempotent_sink(path: str, key: str = "batch") -> Callable[[DataFrame, int], None]:
    """SS-04: a batch that is written again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{key}={number}")

    return write


def without_duplicates(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """SS-05: one row for each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """SS-06: runs of observations without a gap over ``gap``."""
    return stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def windows(stream: DataFrame, time: str, size: str, slide: str | None, late: str, value: str) -> DataFrame:
    """Tumbling or sliding windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "mean")


STAGES = ("waiting for static mask", "mask pending", "detection")


def region_stages(stream: DataFrame, key: str, event: str, time: str, late: str, timeout_ms: int) -> DataFrame:
    """SS-03, SS-07: a region's stage moves on with each event that asks for it; a region without events until the timeout
    is censored with its last stage. One small state a region."""
    kind = dict(stream.dtypes)[key]

    def turn(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, seen = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "stage": [STAGES[stage]], "events": [seen], "censored": [True]})
            return
        stage, seen = state.get if state.exists else (0, 0)
        for frame in frames:
            seen += len(frame)
            stage = min(stage + int((frame[event] == "purchase").sum() > 0), len(STAGES) - 1)
        state.update((stage, seen))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + timeout_ms)
        yield pd.DataFrame({key: [k[0]], "stage": [STAGES[stage]], "events": [seen], "censored": [False]})

    out = T.StructType([T.StructField(key, T._parse_datatype_string(kind)), T.StructField("stage", T.StringType()), T.StructField("events", T.LongType()), T.StructField("censored", T.BooleanType())])
    kept = T.StructType([T.StructField("stage", T.IntegerType()), T.StructField("events", T.LongType())])
    return stream.withWatermark(time, late).groupBy(key).applyInPandasWithState(turn, out, kept, "update", "EventTimeTimeout")
