"""Counts and sums per tile and time window over a stream of points, late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mercator


def tile_counts(points: DataFrame, z: int, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``points`` (ts, lon, lat, value) -> (start, z, x, y, n, total); works on static and streaming frames."""
    rows = points.withColumns({"z": F.lit(z), "x": mercator.tile(mercator.world_x(F.col("lon")), z), "y": mercator.tile(mercator.world_y(F.col("lat")), z)})
    grouped = rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "z", "x", "y")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "z", "x", "y", "n", "total")
