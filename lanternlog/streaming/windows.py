"""Event-time windows and replays of a stream, with state that a watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sessions import apply_once, stream_folder


def window_counts(events: DataFrame, at: str, width: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """(start, by, n): events in each window of event time; windows tumble, or begin every `slide` and overlap. Rows later than the watermark are dropped, as their window's
    state is gone by then; a watermark that a batch raises does so two batches later. Use it in update mode and keep the largest n of each window."""
    n = events.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    return n.select(F.unix_timestamp("w.start").alias("start"), *by, "n")


def drop_replays(events: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first of the rows with one natural key that come at most `within` apart; older keys leave the state."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def available_rows(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what it holds now, and returns the rows of all its batches."""
    folder = stream_folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(apply_once(f"{folder}/rows"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
