"""Event-time aggregates: the batch histogram and share operators as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): counts per window; later rows than ``late`` go."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value").cast("bigint")).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
