"""The operators that also run on streams of frames and log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ID = "recording_id"


def stream_windows(frames: DataFrame, win: str, hop: str, late: str, ts: str = "ts") -> DataFrame:
    """Sliding event-time windows over frame energies; a window closes when ``late`` has passed."""
    w = F.window(ts, win, hop)
    out = frames.withWatermark(ts, late).groupBy(ID, w).agg(
        F.count("*").alias("n_frames"), F.max("rms").alias("peak"), F.sum("rms").alias("energy")
    )
    return out.select(ID, F.col("window.start").alias("win_start"), F.col("window.end").alias("win_end"), "n_frames", "peak", "energy")


def stream_speech_sessions(frames: DataFrame, floor_rms: float, silence: str, late: str, ts: str = "ts") -> DataFrame:
    """Speech regions of a stream: frames above a level, closed by a silence gap.

    The watermark follows all frames, so quiet ones close a region too.  Hence the condition names the time: a filter
    without it would be moved below the watermark.
    """
    loud = frames.withWatermark(ts, late).filter(F.when(F.col(ts).isNotNull(), F.col("rms") >= floor_rms))
    out = loud.groupBy(ID, F.session_window(ts, silence)).agg(F.count("*").alias("n_frames"), F.max("rms").alias("peak"))
    return out.select(
        ID, F.col("session_window.start").alias("from_ts"), F.col("session_window.end").alias("to_ts"), "n_frames", "peak"
    )


def deduplicated(entries: DataFrame, late: str, ts: str = "created_at", id_: str = "id") -> DataFrame:
    """Drop repeated requests that arrive within the watermark."""
    return entries.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_])


def stream_log(
    entries: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", available_now: bool = False
) -> StreamingQuery:
    """Append log entries exactly once to a table with one folder per day."""
    rows = deduplicated(entries, late).withColumn("day", F.to_date("created_at"))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("day").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path)
