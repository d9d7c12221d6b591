"""Streams folded by Spark's built-in streaming aggregation.

Rows are combined before the shuffle, so one hot photo or job does not load
one task with all its events.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_current_labels(label_events: DataFrame) -> DataFrame:
    """Last-write-wins label per photo; update or complete mode."""
    at = F.struct("ts", "event_id")
    return label_events.groupBy("id").agg(F.max_by("label", at).alias("label"))


def stream_progress(ticks: DataFrame) -> DataFrame:
    """Progress per job that never goes back."""
    return ticks.groupBy("job").agg(F.max("done").alias("done"))


def stream_ingest_rate(
    events: DataFrame, delay: str = "10 minutes", width: str = "1 minute"
) -> DataFrame:
    """Files per second in tumbling windows; state is dropped behind the watermark.

    Watermarks need an instant, so a zone-less ``ts`` is read in the session's
    time zone, and ``window_start`` is given back zone-less.
    """
    counted = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "job")
        .agg(F.count("*").alias("done"))
    )
    seconds = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end"))
    return counted.select(
        "job",
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        "done",
        (F.col("done") / seconds).alias("rate"),
    )
