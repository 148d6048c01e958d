"""Streams of events and of candidates. Each has a batch twin, built from the same function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as an instant, and in a stream a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def windowed(events: DataFrame, *, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of each event type in windows of event time; streams drop what is later than `late`."""
    rows = _timed(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "value")


def first_seen(events: DataFrame, *, keys: tuple[str, ...] = ("event_id",), late: str = "1 hour") -> DataFrame:
    """Each event once; a stream forgets keys after the watermark."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def progress(entries: DataFrame) -> DataFrame:
    """Running counts, tokens, seconds and errors of calls; in a stream, the totals so far."""
    return entries.groupBy().agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("tokens"), F.sum("elapsed_s").alias("elapsed_s"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def score_stream(candidates: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Score arriving candidates and append the results; scoring keeps no state."""
    return score(candidates).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_stream(rows: DataFrame, save: Callable[[DataFrame], None], checkpoint: str):
    """Hand each micro-batch to `save`, which must accept a batch twice after a failure, as an upsert does."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: save(batch)).start()
