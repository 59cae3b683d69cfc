"""An extension: evaluation groups over a stream of events, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_groups(stream: DataFrame, time: str, groups: Column, metrics: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and finite-only means per time window and group; works on batch frames alike."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    exploded = rows.select(F.window(time, window).alias("w"), F.explode(groups).alias("grp"), *metrics)
    means = [F.avg(F.when(F.abs(F.col(m)) < float("inf"), F.col(m))).alias(f"mean_{m}") for m in metrics]
    return exploded.groupBy("w", "grp").agg(F.count("*").alias("n"), *means).select(F.col("w.start").alias("start"), "grp", "n", *[f"mean_{m}" for m in metrics])
