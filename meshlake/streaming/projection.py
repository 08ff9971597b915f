"""Extension: events projected as they come, by a stream-static join, and counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import interpolation, polygon
from ..sources.fixtures import lat_of, lon_of


def project_events(events: DataFrame, mesh: DataFrame, polygons: DataFrame, rows: int, columns: int) -> DataFrame:
    """Events ``event_id, ts, user_id, value`` with the ``section, x, y`` of their user's place."""
    e = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", lat_of(F.col("user_id")).alias("lat"), lon_of(F.col("user_id")).alias("lon"))
    return interpolation.project_bilinear(polygon.first_section(e, polygons, ["event_id"]), mesh, rows, columns)


def windowed_counts(projected: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and section; events later than the watermark are dropped."""
    d = projected.withWatermark("ts", late).groupBy(F.window("ts", window), "section").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("window.start").alias("start"), "section", "n", "total")
