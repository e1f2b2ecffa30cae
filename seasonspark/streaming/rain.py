"""Windowed totals over a stream of events, with late data up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(stream: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, cell, total, n; the same code for a batch, where the watermark does nothing."""
    s = stream.withWatermark("ts", late) if stream.isStreaming else stream
    g = s.groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("cell"))
    return g.agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "cell", "total", "n")
