"""The match bins as a stream: the same tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def five_minute_counts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts of a stream of ``ts``, ``event_type``; what comes later than ``late`` is not counted."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
