"""Streams of gauge readings: block maxima as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_maxima(readings: DataFrame, block: str = "1 day", late: str = "1 day", station: str = "station_id", time: str = "ts", value: str = "value") -> DataFrame:
    """(station, block, value): each station's greatest reading by block, for batch and streaming tables alike.

    A block is final once the watermark (``late`` behind the newest reading) has passed it.
    """
    rows = readings.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).groupBy(station, F.window(time, block)).agg(F.max(value).alias(value)).select(station, F.col("window.start").alias("block"), value)
