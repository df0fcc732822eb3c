"""Streaming extensions of our own: hourly weather risk and incremental hit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and mean value per event type and hour."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return w.select(F.col("window.start").alias("hour"), "event_type", "n", "mean_value")


def hits(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Routes per node, each (route, node) once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["route_id", "node_id"]).groupBy("node_id").count()
